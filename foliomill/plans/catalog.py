"""One query per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.doctypes import CONTRACT, DEFAULT, INVOICE, REPORT, DocType
from foliomill.functions import text as X
from foliomill.functions.exact import sums
from foliomill.functions.formula import floor_div, modulo, power, with_metric
from foliomill.functions.replies import parse, readable, unfence
from foliomill.functions.values import clamp01, computed, epoch_micros, items
from foliomill.operators import (
    admission,
    analysis,
    checks,
    classify,
    extract,
    inference,
    line_items,
    long_documents,
    prompts,
    review,
    routing,
    state_store,
    tools,
    trace,
    validate,
)
from foliomill.operators.retrieval import Corpus, search_in_documents
from foliomill.plans.document_run import run
from foliomill.session import shared_folder
from foliomill.sources import business
from foliomill.sources.documents import read_table, spread
from foliomill.streaming import intake, review_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(col: Column | str, digits: int = 6) -> Column:
    return F.round(col, digits)


# --- sources, admission, state ----------------------------------------------------------


@query
def src_documents(spark, sf):
    docs = read_table(spark, f"{sf}/documents.parquet", key="doc_id")
    return docs.select(
        "source_key", F.length("document_text").alias("n_chars"), F.md5("document_text").alias("fingerprint")
    )


def _submissions(spark, sf) -> DataFrame:
    docs = read_table(spark, f"{sf}/documents.parquet", key="doc_id")
    kind = F.expr(
        "CASE source_key % 8 WHEN 0 THEN 'contract' WHEN 1 THEN 'invoice' WHEN 2 THEN 'memo' WHEN 3 THEN 'unknown' END"
    )
    text = F.when(F.col("source_key") % 50 == 7, "").otherwise(F.col("document_text"))
    return docs.withColumns({"requested_type": kind, "document_text": text})


@query
def admit_jobs(spark, sf):
    return admission.with_admission(_submissions(spark, sf)).select("source_key", "accepted", "reason")


@query
def init_jobs(spark, sf):
    docs = read_table(spark, f"{sf}/documents.parquet", key="doc_id")
    jobs = admission.init_jobs(docs, F.lit("2024-01-01 00:00:00"), "source_key")
    return jobs.select(
        "source_key", "job_id", "document_type", "classification_confidence", "summary", "status", "requires_review",
        "approved", "review_feedback", "total_cost", F.size("errors").cast("bigint").alias("error_count"),
        "created_at",
    )


def _versions(spark, sf) -> DataFrame:
    """Every event saves a new version of its user's state."""
    state = F.to_json(F.struct(F.col("event_type").alias("status"), F.col("event_id").alias("step")))
    events = _table(spark, sf, "events")
    return events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("version"), state.alias("state"))


def _wanted(spark, sf) -> DataFrame:
    return _table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"))


@query
def state_latest(spark, sf):
    return state_store.load(_wanted(spark, sf), _versions(spark, sf))


@query
def state_bucketed(spark, sf):
    """Load, a rollback of every job to its first version, and load again, on a table bucketed by job."""
    folder = shared_folder(spark, "versions")
    table = "versions_" + folder.rsplit("-", 1)[-1]
    versions = state_store.create_table(_versions(spark, sf), table, folder, 8)
    first = versions.groupBy("job_id").agg(F.min_by(F.struct("version", "state"), "version").alias("v"))
    snapshots = first.select("job_id", state_store.snapshot_id(F.col("job_id"), F.col("v.version")).alias("snapshot_id"), "v.state")
    restored, _ = state_store.rollback(snapshots.select("job_id", "snapshot_id", F.lit(1).alias("turn")), snapshots, versions)
    before = state_store.load(_wanted(spark, sf), versions).withColumnsRenamed({"version": "version_before", "state": "state_before"})
    after = state_store.load(_wanted(spark, sf), versions.unionByName(restored.select("job_id", "version", "state")))
    return before.join(after, "job_id")


@query
def snapshot_jobs(spark, sf):
    taken, missing = state_store.snapshot(_wanted(spark, sf), _versions(spark, sf), F.lit("2024-02-01"))
    return (
        taken.withColumn("error", F.lit(None).cast("string"))
        .unionByName(missing, allowMissingColumns=True)
        .select("job_id", "snapshot_id", "version", "error")
    )



@query
def rollback_jobs(spark, sf):
    snapshots = _versions(spark, sf).withColumn(
        "snapshot_id", state_store.snapshot_id(F.col("job_id"), F.col("version"))
    )
    # Every snapshot is asked for, a third of them under another job's name.
    asked = (F.col("job_id") + F.expr("CASE WHEN version % 3 = 0 THEN 1 ELSE 0 END")).alias("job_id")
    requests = snapshots.select(asked, "snapshot_id", F.col("version").alias("turn"))
    restored, misses = state_store.rollback(requests, snapshots, _versions(spark, sf))
    return restored.select("job_id", "snapshot_id", "state", F.lit(True).alias("restored")).unionByName(
        misses.select("job_id", "snapshot_id", F.lit(None).cast("string").alias("state"), F.lit(False).alias("restored"))
    )


@query
def rollback_then_load(spark, sf):
    """Jobs with several rollbacks to early versions, loaded afterwards: the last request holds."""
    versions = _versions(spark, sf)
    snapshots = versions.withColumn("snapshot_id", state_store.snapshot_id(F.col("job_id"), F.col("version")))
    # Asked for from the newest to the oldest, so that the oldest must win.
    requests = snapshots.select("job_id", "snapshot_id", (F.lit(1 << 40) - F.col("version")).alias("turn"))
    restored, _ = state_store.rollback(requests, snapshots, versions)
    return state_store.load(_wanted(spark, sf), versions.unionByName(restored.select("job_id", "version", "state")))


@query
def list_snapshots(spark, sf):
    events = _table(spark, sf, "events")
    snapshots = events.select(
        F.col("user_id").alias("job_id"),
        state_store.snapshot_id(F.col("user_id"), F.col("event_id")).alias("snapshot_id"),
        epoch_micros(events, "ts").alias("created_at"),
    )
    return state_store.list_snapshots(snapshots)


@query
def state_json_roundtrip(spark, sf):
    docs = _table(spark, sf, "documents").withColumn("confidence", F.col("doc_id") / 1000)
    packed = docs.select("doc_id", state_store.to_json(["text", "lang", "confidence", "source"]).alias("state"))
    back = state_store.from_json(F.col("state"), "text STRING, lang STRING, confidence DOUBLE, source STRING")
    return packed.withColumn("s", back).select(
        "doc_id", F.md5("s.text").alias("fingerprint"), "s.lang", _r("s.confidence").alias("confidence"), "s.source"
    )


# --- projections and routing ------------------------------------------------------------


@query
def text_window(spark, sf):
    docs = _table(spark, sf, "documents")
    cuts = [F.md5(X.window(F.col("text"), n)).alias(f"first_{n}") for n in (4000, 6000, 8000)]
    return docs.select("doc_id", *cuts)


def _documents(spark, sf, *columns: str) -> DataFrame:
    return business.documents(spark, sf, *columns)


@query
def prompt_columns(spark, sf):
    docs = _documents(spark, sf, "job_id", "kind", "document_text", "extract_json")
    text, kind = F.col("document_text"), F.col("kind")
    cols = []
    for p in ("N", "G"):
        cols += [
            F.md5(prompts.classify_prompt(text)).alias(f"classify_{p.lower()}"),
            F.md5(prompts.extract_prompt(text, kind, p)).alias(f"extract_{p.lower()}"),
            F.md5(prompts.analyze_prompt(text, kind, F.col("extract_json"), F.lit("[]"), p)).alias(f"analyze_{p.lower()}"),
        ]
    return docs.select("job_id", *cols)


def _requested(spark, sf) -> DataFrame:
    docs = _documents(spark, sf, "job_id", "kind", "fields_reply", "document_text").withColumns({"document_type": F.col("kind"), "errors": F.array().cast("array<string>")})
    return extract.extract_requested(docs, "fields_reply")


@query
def project_fields(spark, sf):
    fields = _requested(spark, sf).select("job_id", F.explode("fields").alias("field", "json"))
    number = F.col("json").try_cast("double")
    return fields.select(
        "job_id", "field", number.alias("as_number"), F.when(number.isNull(), F.col("json")).alias("as_json")
    )


def _jobs(spark, sf) -> DataFrame:
    """A jobs table with gaps: orders in their states."""
    orders = _table(spark, sf, "orders")
    return orders.select(
        F.col("o_orderkey").alias("job_id"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'review' WHEN 'P' THEN "
               "CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'extracting' WHEN 2 THEN 'failed' END END").alias("status"),
        F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'invoice' WHEN 1 THEN 'report' END").alias("document_type"),
        F.expr("CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus = 'O' END").alias("requires_review"),
        F.expr("CASE o_orderkey % 4 WHEN 0 THEN array('a: x', 'b: y') WHEN 1 THEN array('a: x') END").alias("errors"),
        F.col("o_orderdate").alias("created_at"),
        F.expr("CASE WHEN o_orderkey % 3 <> 2 THEN o_orderdate + INTERVAL 5 SECONDS END").alias("updated_at"),
    )


@query
def job_status(spark, sf):
    out = routing.job_status(_jobs(spark, sf))
    times = {c: epoch_micros(out, c) for c in ("created_at", "updated_at")}
    return out.withColumns({"error_count": F.col("error_count").cast("bigint"), **times})


@query
def inflight_jobs(spark, sf):
    return routing.inflight_jobs(_jobs(spark, sf))


def _with_errors(spark, sf, *columns: str) -> DataFrame:
    return _documents(spark, sf, *columns).withColumn("errors", F.array().cast("array<string>"))


RUN_INPUT = ("job_id", "document_text", "requested_type", "classify_reply", "extract_reply", "errors")


def _run(spark, sf, profile: str = "N", stages: trace.StageTrace | None = None) -> DataFrame:
    replies = ("analysis_reply",) if profile == "N" else ("fields_reply", "analysis_g_reply")
    docs = _with_errors(spark, sf, *RUN_INPUT, *replies)
    if profile == "N":
        return run(docs.select(*RUN_INPUT, "analysis_reply"), stages=stages)
    docs = docs.withColumns({"extract_reply": F.col("fields_reply"), "analysis_reply": F.col("analysis_g_reply")})
    return run(docs.select(*RUN_INPUT, "analysis_reply"), profile="G", stages=stages)


@query
def review_queue(spark, sf):
    return routing.review_queue(_run(spark, sf)).select("job_id", "document_type", "status", "requires_review", "approved")


@query
def final_output(spark, sf):
    out = routing.final_output(_run(spark, sf))
    return out.select("job_id", "document_type", "status", "requires_review", "approved", "summary")


@query
def route_extraction(spark, sf):
    return _documents(spark, sf, "job_id", "kind").select("job_id", "kind", extract.route(F.col("kind")).alias("route"))


@query
def gate_overall(spark, sf):
    docs = _run(spark, sf, "G")
    gate = routing.gate_overall(F.col("confidence"), F.col("anomaly_count"))
    return docs.select(
        "job_id", "document_type", _r("confidence").alias("confidence"), F.col("anomaly_count").cast("bigint"),
        gate.alias("gate"), F.col("gate").alias("gate_with_errors"),
    )


@query
def gate_rules(spark, sf):
    return _run(spark, sf).select(
        "job_id", "document_type", "classification_confidence", validate.failed_rules(F.col("checks")).alias("failed"), "gate"
    )


@query
def stage_errors(spark, sf):
    return _run(spark, sf).select("job_id", F.posexplode("errors").alias("pos", "error")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


@query
def stage_trace(spark, sf):
    """Rows in, rows out and failures of every stage, counted while the run is written."""
    stages = trace.StageTrace()
    rows = stages.write(_run(spark, sf, stages=stages), lambda df: df.write.format("noop").mode("overwrite").save())
    return rows.select("node_name", "rows_in", "rows_out", "failures")


# --- model replies ----------------------------------------------------------------------


@query
def batch_infer(spark, sf):
    docs = _documents(spark, sf, "job_id", "document_text").select("job_id", prompts.classify_prompt(F.col("document_text")).alias("prompt"))
    return inference.infer(docs, "prompt", inference.keyword_model).select("job_id", "reply", "reply_error")


@query
def batch_infer_once(spark, sf):
    """A first run pays for the invoices' prompts, a second one over all documents for the rest."""
    docs = _documents(spark, sf, "job_id", "kind", "document_text").select("job_id", "kind", prompts.classify_prompt(F.col("document_text")).alias("prompt"))
    kept = shared_folder(spark, "replies")
    inference.infer_once(docs.filter("kind = 'invoice'"), "prompt", inference.keyword_model, kept, "first")
    return inference.infer_once(docs, "prompt", inference.keyword_model, kept, "second").select("job_id", "reply", "reply_error")


@query
def parse_replies(spark, sf):
    docs = _documents(spark, sf, "job_id", "classify_reply").select("job_id", unfence(F.col("classify_reply")).alias("text"))
    docs = docs.withColumn("p", parse(F.col("text"), "type STRING, confidence STRING"))
    ok = F.coalesce(readable(F.col("text"), F.col("p")), F.lit(False))
    docs = docs.withColumn("readable", ok)
    return docs.select(
        "job_id",
        "readable",
        F.when(F.col("readable"), F.col("p.type")).alias("type"),
        F.when(F.col("readable"), F.col("p.confidence").try_cast("double")).alias("confidence"),
    )


@query
def classify_docs(spark, sf):
    docs = _with_errors(spark, sf, "job_id", "requested_type", "classify_reply").select(
        "job_id", "requested_type", "classify_reply", "errors"
    )
    n = classify.classify(docs).withColumnsRenamed(
        {"document_type": "type_n", "classification_confidence": "confidence_n", "status": "status_n"}
    )
    both = classify.classify(n.withColumn("errors", F.array().cast("array<string>")), profile="G")
    return both.select(
        "job_id", "type_n", "confidence_n", "status_n", F.col("document_type").alias("type_g"),
        F.col("classification_confidence").alias("confidence_g"), F.col("status").alias("status_g"),
    )


def _n(col) -> Column:
    return F.coalesce(F.size(col), F.lit(0)).cast("bigint")


@query
def extract_contracts(spark, sf):
    docs = extract.extract_type(_documents(spark, sf, "job_id", "contract_reply"), CONTRACT, "contract_reply")
    return docs.select(
        "job_id", "readable", F.col("data.effective_date").cast("string").alias("effective_date"), F.col("data.expiration_date").cast("string").alias("expiration_date"), _n("data.parties").alias("n_parties"),
        F.array_join("data.parties", "|").alias("parties"), _n("data.clauses").alias("n_clauses"),
        F.array_join(F.col("data.clauses.title"), "|").alias("titles"),
        F.col("data.obligations")[0]["obligation"].alias("obligation"), F.col("data.terms.duration").alias("duration"),
        F.col("data.terms.termination").alias("termination"),
    )


LONG_SIZE, LONG_OVERLAP = 1000, 100


def _chunk_reply(text: Column) -> Column:
    """Stand-in for the model on one chunk: parties and signatures by their notation, every ninth reply broken."""
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    clauses = F.transform(found("Signature of (P[0-9])"), lambda p: F.struct(F.concat(F.lit("Signature "), p).alias("title"), p.alias("text")))
    date = F.nullif(F.regexp_extract(text, "Effective ([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit(""))
    terms = F.struct(F.nullif(F.regexp_extract(text, "lasts ([0-9]+ months)", 1), F.lit("")).alias("duration"))
    reply = F.to_json(F.struct(found("(P[0-9])").alias("parties"), date.alias("effective_date"), clauses.alias("clauses"), terms.alias("terms")))
    return F.when((F.length(text) % 9 == 4) & ~text.contains("Signature"), F.substring(reply, 1, 12)).otherwise(reply)


@query
def extract_long_contracts(spark, sf):
    """Whole texts framed as contracts: parties at the top, the signature clause in the last chunk."""
    texts = _texts(spark, sf)
    head = F.concat(F.lit("Between P"), F.col("doc_id") % 7, F.lit(" and P"), F.col("doc_id") % 5, F.lit(", lasts "), F.col("doc_id") % 30, F.lit(" months. "))
    tail = F.concat(F.lit(" Effective 2024-01-1"), F.col("doc_id") % 9, F.lit(". Signature of P"), F.col("doc_id") % 7)
    docs = texts.select("doc_id", F.concat(head, F.coalesce("text", F.lit("")), tail).alias("document_text"))
    calls = long_documents.chunks(docs, "document_text", LONG_SIZE, LONG_OVERLAP).withColumn("reply", _chunk_reply(F.col("chunk_text")))
    parsed = extract.extract_type(calls.select("doc_id", "chunk_no", "reply"), CONTRACT, "reply")
    parsed = parsed.withColumn("data", F.when(F.col("readable"), F.col("data")))
    out = long_documents.merge(parsed, ["doc_id"])
    return out.select(
        "doc_id", F.col("n_chunks").cast("bigint"), F.col("n_unreadable").cast("bigint"), F.array_join("data.parties", "|").alias("parties"),
        F.array_join("data.clauses.title", "|").alias("clauses"), F.try_variant_get("data.effective_date", "$", "string").alias("effective_date"), F.col("data.terms.duration").alias("duration"),
    )


@query
def extract_invoices(spark, sf):
    docs = extract.extract_type(_documents(spark, sf, "job_id", "invoice_reply"), INVOICE, "invoice_reply")
    return docs.select(
        "job_id", "readable", F.col("data.vendor").cast("string").alias("vendor"), F.col("data.invoice_number").cast("string").alias("invoice_number"), "data.invoice_date", "data.due_date",
        _n("data.line_items").alias("n_items"), F.array_join("data.line_items.description", "|").alias("descriptions"),
        F.array_join("data.line_items.qty", "|").alias("qty"),
        F.col("data.tax").try_cast("double").alias("tax"), F.col("data.grand_total").try_cast("double").alias("grand_total"),
    )


@query
def extract_reports(spark, sf):
    docs = extract.extract_type(_documents(spark, sf, "job_id", "report_reply"), REPORT, "report_reply")
    first = F.get(F.col("data.kpis"), F.lit(0))
    return docs.select(
        "job_id", "readable", F.col("data.title").cast("string").alias("title"), F.col("data.period").cast("string").alias("period"), _n("data.kpis").alias("n_kpis"),
        first["name"].alias("kpi"), F.try_variant_get(first["value"], "$", "string").alias("value"),
        first["unit"].alias("unit"), _n("data.sections").alias("n_sections"),
        F.get(F.col("data.sections"), F.lit(0))["summary"].alias("first_summary"),
    )


NAMED = ("invoice_number", "total", "period", "nothing")


@query
def extract_named_fields(spark, sf):
    """A caller's own list of fields, from replies that may sit in a code fence with words around it."""
    docs = _documents(spark, sf, "job_id", "fields_reply", "k").withColumn("reply", F.concat(F.lit("Sure! "), F.col("fields_reply"), F.lit(" Done.")))
    docs = docs.withColumn("reply", F.when(F.col("k") % 4 == 0, F.col("fields_reply")).otherwise(F.col("reply")))
    rows = extract.extract_fields(docs.select("job_id", "reply"), NAMED).select("job_id", F.explode("fields").alias("field", "json"))
    number = F.col("json").try_cast("double")
    return rows.select("job_id", "field", number.alias("as_number"), F.when(number.isNull(), F.col("json")).alias("as_json"))


# A type of the user's own: a letter has a sender and paragraphs.
LETTER = DocType(
    name="letter",
    schema="sender STRING, topics ARRAY<STRING>",
    checks=lambda d: [
        checks.Check("sender_present", F.coalesce(d.getField("sender") != "", F.lit(False)), "Sender given", "No sender"),
        checks.Check("topics_present", items(d.getField("topics")) >= 2, "Topics given", "Fewer than two topics"),
    ],
    broken=checks.never_broken,
    shape='{"sender", "topics"}',
    expert="correspondence",
)


@query
def new_document_type(spark, sf):
    """The given texts as letters: a registered type goes through all stages as they are."""
    topics = F.slice(F.regexp_extract_all("document_text", F.lit("[A-Z][a-z]+ing"), F.lit(0)), 1, 3)
    sender = F.when(F.col("source_key") % 3 == 0, "").otherwise(F.concat(F.lit("S"), F.col("source_key")))
    docs = read_table(spark, f"{sf}/documents.parquet", key="doc_id").withColumn("job_id", F.col("source_key"))
    docs = docs.withColumns(
        {
            "requested_type": F.when(F.col("source_key") % 5 != 1, "letter"),
            "classify_reply": F.lit('{"type": "letter", "confidence": 0.75}'),
            "extract_reply": F.to_json(F.struct(sender.alias("sender"), topics.alias("topics"))),
            "analysis_reply": F.lit('{"summary": "s"}'),
            "errors": F.array().cast("array<string>"),
        }
    )
    out = run(docs, registry=DEFAULT.with_type(LETTER))
    return out.select("job_id", "document_type", validate.failed_rules(F.col("checks")).alias("failed"), "gate", F.col("letter.sender").alias("sender"))


@query
def user_tools(spark, sf):
    """Two tools of the user's own over whole texts: an address finder in columns and a word measure in pandas."""

    @F.pandas_udf("bigint")
    def longest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: max(map(len, t.split(" ")), default=0))

    found = {"addresses": lambda t: F.size(F.regexp_extract_all(t, F.lit("[a-z0-9.]+@[a-z0-9.]+"), F.lit(0))).cast("bigint"), "longest_word": longest}
    return tools.apply(_texts(spark, sf), found, "text").select("doc_id", *found)


@query
def extract_table(spark, sf):
    docs = _documents(spark, sf, "job_id", "table_reply").select("job_id", "table_reply")
    rows = extract.extract_table(docs, ("item", "qty"), "table_reply", keep=("job_id",))
    return rows.withColumn("row_no", F.col("row_no").cast("bigint"))


@query
def analysis_counts(spark, sf):
    docs = analysis.analyze(_with_errors(spark, sf, "job_id", "analysis_reply").select("job_id", "analysis_reply", "errors"))
    severe = [analysis.severity_count(F.col("risks"), s).cast("bigint").alias(f"{s}_risks") for s in ("high", "medium", "low")]
    counts = [F.col(c).cast("bigint").alias(c) for c in ("risk_count", "anomaly_count", "insight_count")]
    return docs.select("job_id", *counts, *severe, "summary", "status")


# --- text and retrieval -----------------------------------------------------------------


@query
def extract_dates(spark, sf):
    docs = _documents(spark, sf, "job_id", "document_text")
    dates = F.posexplode(X.extract_dates(F.col("document_text"))).alias("pos", "value")
    return docs.select("job_id", dates).withColumn("pos", F.col("pos").cast("bigint"))


@query
def extract_amounts(spark, sf):
    docs = _documents(spark, sf, "job_id", "document_text")
    amounts = F.posexplode(X.extract_amounts(F.col("document_text"))).alias("pos", "value")
    return docs.select("job_id", amounts).withColumn("pos", F.col("pos").cast("bigint"))


@query
def paragraphs(spark, sf):
    docs = _documents(spark, sf, "job_id", "document_text")
    parts = F.posexplode(X.paragraphs(F.col("document_text"))).alias("pos", "paragraph")
    return docs.select("job_id", parts).withColumn("pos", F.col("pos").cast("bigint"))


def _texts(spark, sf) -> DataFrame:
    return spread(_table(spark, sf, "documents").select("doc_id", "text"))


@query
def token_counts(spark, sf):
    words = X.tokens(F.col("text"))
    docs = _texts(spark, sf).select("doc_id", words.alias("t"))
    return docs.select("doc_id", _n("t").alias("n_tokens"), _n(F.array_distinct("t")).alias("n_distinct"))


# Search requests over the documents: words of several languages, a repeated word, no word at all.
SEARCHES = {
    "plain": "is the tion on",
    "repeated": "der die der und",
    "mixed": "Que la, QUE zzz1",
    "nohit": "qqqqq wwwww",
    "notoken": "!?",
    "empty": "",
}
PARAGRAPH_SEARCH = "the und la payment scope"


def _corpus(spark, sf) -> Corpus:
    return Corpus(_texts(spark, sf), spark.createDataFrame(list(SEARCHES.items()), "query string, text string"))


@query
def bm25_stats(spark, sf):
    return _corpus(spark, sf).summary().withColumn("avg_length", _r("avg_length"))


@query
def bm25_df(spark, sf):
    return _corpus(spark, sf).frequencies


@query
def bm25_scores(spark, sf):
    return _corpus(spark, sf).scores().withColumn("score", _r("score"))


@query
def bm25_topk(spark, sf):
    return _corpus(spark, sf).top_k(8).select("query", F.col("rank").cast("bigint"), "doc_id", _r("score").alias("score"))


@query
def bm25_fallback(spark, sf):
    out = _corpus(spark, sf).top_k_or_first(5)
    return out.select("query", F.col("rank").cast("bigint"), "doc_id", _r("score").alias("score"), "fallback")


def _benchmark_corpus(spark, sf) -> Corpus:
    """Every benchmark text is a query."""
    return Corpus(_texts(spark, sf), _table(spark, sf, "benchmark"), query="item_id", first=10)


@query
def bm25_benchmark(spark, sf):
    out = _benchmark_corpus(spark, sf).top_k_or_first(10)
    return out.select("item_id", F.col("rank").cast("bigint"), "doc_id", _r("score").alias("score"), "fallback")


@query
def bm25_benchmark_df(spark, sf):
    return _benchmark_corpus(spark, sf).frequencies


@query
def bm25_in_document(spark, sf):
    """Search inside every document, lines as paragraphs."""
    docs = _texts(spark, sf)
    out = search_in_documents(docs, PARAGRAPH_SEARCH, separator="\n")
    return out.select(
        "doc_id", F.col("rank").cast("bigint"), F.col("pos").cast("bigint"), _r("score").alias("score"),
        F.md5("paragraph").alias("paragraph"), "fallback",
    )


@query
def bm25_in_business_document(spark, sf):
    """Search inside every rendered document, each with its own query."""
    docs = _documents(spark, sf, "job_id", "document_text", "k", "kind")
    asked = F.expr("CASE k % 4 WHEN 0 THEN 'grand total' WHEN 1 THEN 'buyer fee fee' WHEN 2 THEN '...' ELSE kind END")
    out = search_in_documents(docs.withColumn("asked", asked), F.col("asked"), key="job_id", text="document_text", top_k=2)
    return out.select(
        "job_id", F.col("rank").cast("bigint"), F.col("pos").cast("bigint"), _r("score").alias("score"), "paragraph", "fallback"
    )


# --- rules ------------------------------------------------------------------------------


def _rules(spark, sf, kind, reply) -> DataFrame:
    docs = extract.extract_type(_documents(spark, sf, "job_id", reply).select("job_id", reply), kind, reply)
    docs = validate.check_type(docs.filter("NOT unusable"), kind)
    return validate.long_checks(docs)


@query
def rules_contract(spark, sf):
    return _rules(spark, sf, CONTRACT, "contract_reply")


@query
def rules_invoice(spark, sf):
    return _rules(spark, sf, INVOICE, "invoice_reply")


@query
def rules_report(spark, sf):
    return _rules(spark, sf, REPORT, "report_reply")


@query
def rules_unknown(spark, sf):
    rows = validate.long_checks(_run(spark, sf), "document_type")
    return rows.filter("document_type = 'unknown'").select("job_id", "rule", "passed", "detail")


@query
def rules_required_fields(spark, sf):
    docs = _requested(spark, sf).select("job_id", validate.required_checks(F.col("fields"), F.col("document_type")).alias("checks"))
    return computed(docs, "checks").select("job_id", F.inline("checks"))


@query
def rules_total_validation(spark, sf):
    """Every order as an invoice: do the amounts of its text add up to the stated total?"""
    docs = _documents(spark, sf, "job_id", "invoice_text", "fields_reply").withColumns(
        {"document_type": F.lit("invoice"), "errors": F.array().cast("array<string>")}
    )
    docs = validate.validate_requested(extract.extract_requested(docs, "fields_reply", "invoice_text"))
    rows = docs.select("job_id", F.inline("checks")).filter(F.col("check") == "total_validation")
    return rows.select("job_id", "field", "check", "passed", "message")


@query
def line_item_math_detail(spark, sf):
    docs = extract.extract_type(_documents(spark, sf, "job_id", "invoice_reply"), INVOICE, "invoice_reply")
    docs = computed(docs.filter("NOT unusable").select("job_id", checks.line_errors(F.col("data")).alias("wrong")), "wrong")
    return docs.select("job_id", F.inline("wrong")).withColumn("line", F.col("line").cast("bigint"))


def _lines(spark, sf) -> DataFrame:
    """Line items as a table; some listed totals are off by 1.00 or by exactly one cent."""
    parts = _table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    lines = _table(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    total = F.expr(
        "round(CAST(l_quantity AS DECIMAL(18,4)) * CAST(p_retailprice AS DECIMAL(18,4)), 2)"
        " + CASE WHEN l_linenumber = 1 AND l_orderkey % 7 = 0 THEN 1.00 WHEN l_linenumber = 2 AND l_orderkey % 13 = 0"
        " THEN 0.01 ELSE 0.00 END"
    )
    return lines.select(
        F.col("l_orderkey").alias("job_id"),
        F.col("l_linenumber").cast("bigint").alias("line"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").alias("position"),
        F.col("p_name").alias("description"),
        F.col("l_quantity").alias("qty"),
        F.col("p_retailprice").alias("unit_price"),
        total.alias("total"),
        "l_partkey",
        "l_suppkey",
    )


def _headers(spark, sf) -> DataFrame:
    """Header of every order: the sum of its lines plus tax, wrong for some orders."""
    orders = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"))
    sums = line_items.with_expected(_lines(spark, sf)).groupBy("job_id").agg(F.sum("expected").alias("s"))
    sums = orders.join(sums, "job_id", "left").withColumn("s", F.coalesce("s", F.lit(0).cast("decimal(38,2)")))
    wrong = F.expr("CASE WHEN job_id % 17 = 0 THEN 0.01 WHEN job_id % 19 = 0 THEN 5.00 ELSE 0.00 END")
    return sums.select(
        "job_id",
        F.expr("CAST(job_id % 100 AS DECIMAL(18,4))").alias("tax"),
        (F.col("s") + F.expr("job_id % 100") + wrong).cast("decimal(30,6)").alias("grand_total"),
        (F.col("s") + wrong).cast("decimal(30,6)").alias("net_total"),
    )


@query
def rules_invoice_lines(spark, sf):
    return line_items.invoice_checks(_headers(spark, sf), _lines(spark, sf))


@query
def line_table_math_errors(spark, sf):
    return line_items.math_errors(_lines(spark, sf))


@query
def duplicate_items(spark, sf):
    marked = line_items.mark_repeats(_lines(spark, sf))
    return marked.filter("repeated").select("job_id", "line", "l_partkey", "l_suppkey", "description")


@query
def repeated_descriptions(spark, sf):
    return line_items.repeats(_lines(spark, sf))


# --- roll-ups ---------------------------------------------------------------------------


@query
def pass_rate(spark, sf):
    return _run(spark, sf).select("job_id", F.size("checks").cast("bigint").alias("n_checks"), _r("pass_rate").alias("pass_rate"))


@query
def pass_rate_from_table(spark, sf):
    """The same rate from the long table of checks."""
    jobs = _documents(spark, sf, "job_id").select("job_id")
    found = _rules(spark, sf, INVOICE, "invoice_reply")
    return validate.pass_rate_table(jobs, found).select("job_id", _r("pass_rate").alias("pass_rate"))


@query
def rule_tally(spark, sf):
    return validate.rule_tally(validate.long_checks(_run(spark, sf), "document_type"), "document_type", "rule")


@query
def overall_confidence(spark, sf):
    return _run(spark, sf).select("job_id", _r("confidence").alias("confidence"))


@query
def sum_values(spark, sf):
    """Sum of line prices per part, also for parts that were never sold."""
    parts = _table(spark, sf, "part").select("p_partkey")
    lines = _table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_extendedprice")
    sums = line_items.sum_values(lines, "l_extendedprice", "p_partkey")
    out = parts.join(sums, "p_partkey", "left").fillna(0.0, ["total"]).fillna(0, ["n_values"])
    return out.select("p_partkey", _r("total").alias("total"), "n_values")


@query
def sum_exact(spark, sf):
    """Prices among values 280 digits larger that cancel, per part; odd parts have what is no number, too."""
    lines = _table(spark, sf, "lineitem")
    price = F.col("l_extendedprice")
    large = F.lit(1e280) * price
    odd = F.expr("CASE l_partkey % 50 WHEN 1 THEN double('Infinity') WHEN 2 THEN double('NaN') WHEN 3 THEN CASE WHEN l_linenumber = 1 THEN double('Infinity') ELSE double('-Infinity') END END")
    values = lines.select("l_partkey", "l_linenumber", F.explode(F.array(large, price, F.lit(1e-200), -large, odd, F.lit(-1e-200))).alias("v"))
    out = sums(values, ["l_partkey"], {"total": F.col("v")}, {"n_values": F.col("v").isNotNull()})
    shown = F.when(F.isnan("total"), "no number").when(F.abs("total") == float("inf"), "infinite").otherwise(_r("total", 2).try_cast("decimal(30,2)").cast("string"))
    return out.select("l_partkey", shown.alias("total"), "n_values")


@query
def reconcile_totals(spark, sf):
    lines = line_items.with_expected(_lines(spark, sf))
    out = line_items.reconcile(_headers(spark, sf), lines, "expected", "net_total")
    return out.select("job_id", "actual", "expected", "matches")


def _trace(spark, sf) -> DataFrame:
    """Events as stage records, with gaps."""
    events = _table(spark, sf, "events")
    return events.select(
        "event_id",
        F.col("user_id").alias("job_id"),
        F.expr("CASE WHEN event_id % 11 <> 4 THEN event_type END").alias("node_name"),
        F.col("ts").alias("started_at"),
        (F.col("ts") + F.expr("make_dt_interval(0, 0, 0, CAST(value AS DECIMAL(18,6)) / 1000)")).alias("completed_at"),
        F.expr("CASE WHEN event_id % 10 <> 3 THEN value END").alias("duration_ms"),
        F.expr("CASE WHEN event_id % 7 <> 2 THEN value / 1000 END").alias("cost"),
        F.expr("CASE WHEN event_type = 'error' THEN concat('failed ', event_id) END").alias("error"),
        F.expr("CASE event_id % 5 WHEN 0 THEN array('document_text') WHEN 1 THEN array('extracted_data', 'document_type') END").alias("input_keys"),
        F.expr("CASE event_id % 3 WHEN 0 THEN array(event_type, 'status') END").alias("output_keys"),
    )


@query
def job_trace(spark, sf):
    steps = _trace(spark, sf)
    times = {c: epoch_micros(steps, c) for c in ("started_at", "completed_at")}
    out = trace.ordered(steps.withColumns(times))
    keys = {c: F.array_join(c, ",") for c in ("input_keys", "output_keys")}
    return out.withColumns({"cost": _r("cost"), **keys})


def _totals(df: DataFrame) -> DataFrame:
    return df.withColumns({c: _r(c) for c in ("total_cost", "total_duration_ms")})


@query
def trace_totals(spark, sf):
    return _totals(trace.totals(_trace(spark, sf), "job_id"))


@query
def trace_by_node(spark, sf):
    return _totals(trace.totals(trace.view(_trace(spark, sf)), "job_id", "node_name"))


@query
def step_duration(spark, sf):
    return trace.with_duration(_trace(spark, sf)).select("event_id", _r("duration_ms").alias("duration_ms"))


@query
def pct_change(spark, sf):
    """Change of each user's value against the event before, in steps of 25."""
    events = _table(spark, sf, "events")
    rows = events.select(
        "event_id", "user_id", epoch_micros(events, "ts").alias("at"), F.floor(F.col("value") / 25).cast("double").alias("new_value")
    )
    out = line_items.change_over_time(rows, ["user_id"], "at", ["event_id"], "new_value")
    return out.select("event_id", "user_id", "old_value", "new_value", _r("pct_change").alias("pct_change"), "change_error")


@query
def derived_metric(spark, sf):
    lines = _table(spark, sf, "lineitem")
    formula = "try_divide(l_extendedprice * (1 - l_discount), l_quantity - 10) + sqrt(l_tax * 100)"
    out = with_metric(lines, "metric", formula)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "metric", "metric_error")


@query
def scalar_functions(spark, sf):
    parts = _table(spark, sf, "part")
    a, b = F.col("p_size") - 25, (F.col("p_partkey") % 7 - 3).cast("int")
    return parts.select(
        "p_partkey",
        floor_div(a, b).cast("double").alias("floor_div"),
        modulo(a, b).cast("double").alias("modulo"),
        _r(power(F.lit(1.01), a * 30)).alias("power"),
        clamp01(a / F.lit(20.0)).alias("clamped"),
        _r(F.log10("p_retailprice")).alias("log10"),
        _r(F.ln("p_retailprice") + F.sin(a) + F.cos(a) + F.tan(a) + F.sqrt(F.abs(a)) + F.pi() + F.e()).alias("mixed"),
        (F.ceil(F.col("p_retailprice") / 7) - F.floor(F.col("p_retailprice") / 7)).cast("bigint").alias("gap"),
    )


# --- review -----------------------------------------------------------------------------


def _actions(events: DataFrame) -> DataFrame:
    """signup submits, purchase approves, error rejects; some rejections lack feedback."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    action = F.expr("CASE event_type WHEN 'signup' THEN 'submit' WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' END")
    feedback = F.when(k % 9 != 0, F.concat(F.lit("note "), k.cast("string"))).otherwise("")
    out = events.select(
        F.col("user_id").cast("string").alias("job_id"),
        epoch_micros(events, "ts").alias("at"),
        F.col("event_id").alias("seq"),
        action.alias("action"),
        feedback.alias("feedback"),
    )
    return out.filter("action IS NOT NULL")


@query
def decision_guard(spark, sf):
    decisions = _actions(_table(spark, sf, "events")).filter("action <> 'submit'")
    jobs = _table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("job_id"),
        F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'review' WHEN 1 THEN 'complete' WHEN 2 THEN 'pending' ELSE 'failed' END").alias("status"),
        F.expr("s_suppkey % 8 = 2").alias("requires_review"),
    )
    return review.guard(decisions, jobs).select("seq", "job_id", "action", "verdict")


@query
def review_outcome(spark, sf):
    return review.outcomes(_actions(_table(spark, sf, "events"))).select("job_id", "seq", "action", "outcome")


@query
def review_status(spark, sf):
    return review.job_states(review.outcomes(_actions(_table(spark, sf, "events"))))


# --- streams ----------------------------------------------------------------------------


def _stream(spark, sf, name: str) -> DataFrame:
    schema = _table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query
def stream_intake(spark, sf):
    folder = shared_folder(spark, "intake")
    jobs = business.render(_stream(spark, sf, "orders"), *RUN_INPUT, "analysis_reply").withColumn("errors", F.array().cast("array<string>"))
    intake.start(jobs.select(*RUN_INPUT, "analysis_reply"), run, folder, available_now=True).awaitTermination()
    return intake.read(spark, folder).select("job_id", "document_type", "gate", "status")


@query
def stream_review(spark, sf):
    folder = shared_folder(spark, "review")
    review_stream.start(_actions(_stream(spark, sf, "events")), folder, available_now=True).awaitTermination()
    return review_stream.current(spark, folder)
