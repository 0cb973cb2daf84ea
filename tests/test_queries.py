import oracle_check
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from foliomill.plans import catalog
from foliomill.sources import business

FAST = [
    "src_documents", "admit_jobs", "state_latest", "rollback_jobs", "classify_docs", "extract_table", "extract_dates",
    "rules_contract", "rules_invoice", "rules_report", "rules_required_fields", "rules_total_validation", "rules_invoice_lines",
    "gate_rules", "gate_overall", "stage_errors", "review_queue", "bm25_fallback", "bm25_benchmark", "bm25_in_document", "trace_totals",
    "derived_metric", "sum_exact", "job_status", "job_trace", "rollback_then_load", "review_outcome", "stream_intake", "stream_review", "stage_trace", "extract_named_fields", "new_document_type", "user_tools", "extract_long_contracts", "batch_infer", "batch_infer_once", "state_bucketed",
]


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(SMALL)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, con, name):
    ok, note = oracle_check.compare(spark, con, SMALL, name)
    assert ok, note


def test_every_sql_has_a_query_and_entry_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("kind", ["contract", "invoice", "report"])
def test_every_rule_passes_and_fails_somewhere(spark, kind):
    rows = getattr(catalog, f"rules_{kind}")(spark, SMALL).groupBy("rule").pivot("passed", [True, False]).count().collect()
    assert rows and all(r["true"] and r["false"] for r in rows), rows


def test_run_has_no_shuffle_and_reads_few_columns(spark):
    docs = business.render(spark.read.parquet(f"{SMALL}/orders.parquet"), *catalog.RUN_INPUT, "analysis_reply")
    from pyspark.sql import functions as F

    plan = catalog.run(docs.withColumn("errors", F.array().cast("array<string>"))).select("job_id", "gate")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "o_orderpriority" not in text
