"""Work per task and per row: what grows with the tables must stay bounded."""

import re

import pytest
from conftest import SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliomill.functions import exact
from foliomill.functions.values import SPACE, strip
from foliomill.operators import retrieval
from foliomill.plans import catalog
from foliomill.sources.documents import spread_rows


def _optimized(spark, name: str) -> str:
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000000")
    return catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_one_file_split_are_dealt_evenly(spark):
    dealt = spread_rows(spark.range(0, 1000, 1, 1), rows=100)
    sizes = [n for (n,) in dealt.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 10 and max(sizes) <= 150


@pytest.mark.parametrize("name", ["project_fields", "extract_named_fields", "rules_invoice", "line_item_math_detail"])
def test_replies_are_not_parsed_below_a_filter_of_their_own_result(spark, name):
    plan = _optimized(spark, name)
    below = plan[plan.rindex("Repartition") :]
    assert "from_json" not in below and "regexp_replace" not in below


def test_a_check_is_decided_once(spark):
    # Once for the verdict, once for the text of a failed check.
    assert _optimized(spark, "rules_invoice").count("array_position(") == 2


def test_strip_takes_all_white_space_and_nothing_else(spark):
    odd = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000] + ["﻿", "​", ""]
    texts = [(f"{c} a{c}b {c}\n",) for c in odd] + [(c,) for c in odd] + [(None,)]
    by_pattern = F.regexp_replace("t", rf"(?U)^{SPACE}+|{SPACE}+$", "")
    rows = spark.createDataFrame(texts, "t string").filter(~strip(F.col("t")).eqNullSafe(by_pattern))
    assert rows.count() == 0


@pytest.mark.parametrize("ties", [2, 100_000])
def test_best_of_each_task_are_those_of_the_full_scores(spark, monkeypatch, ties):
    monkeypatch.setattr(retrieval, "TIES", ties)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        words = ["red", "blue", "green red", "red red blue", "black", ""]
        docs = [(None if i % 17 == 3 else i // 2 if i % 5 == 0 else i, " ".join(words[(i * j) % 6] for j in range(1, i % 7))) for i in range(120)]
        docs += [(1000 + i, "red blue blue") for i in range(40)]
        asked = [("a", "red blue red"), ("b", "green"), (None, "blue black"), ("c", "nothing"), ("d", None)]
        corpus = retrieval.Corpus(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(asked, "query string, text string"))
        order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
        full = corpus.scores().withColumn("rank", F.row_number().over(order)).filter("rank <= 6")
        best = corpus.top_k(6)
        assert sorted(map(str, best.select(full.columns).collect())) == sorted(map(str, full.collect())) != []
        # No aggregate over pairs of a query and a document.
        assert "collect_list(_p#" not in best._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_exact_sums_move_one_row_per_sum_and_place(spark):
    df = spark.createDataFrame([(1, 0.1), (1, None), (2, None), (2, 3.5)], "g bigint, v double")
    out = exact.sums(df, ["g"], {"total": F.col("v")}, {"n": F.col("v").isNotNull()})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[g#\d+L, slot#\d+\]", plan)
    assert sorted(map(tuple, out.collect())) == [(1, 0.1, 1), (2, 3.5, 1)]


def test_rendering_is_not_one_method_the_jvm_does_not_compile(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    catalog.QUERIES["gate_rules"](spark, SMALL)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000
