import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from foliomill.doctypes import CONTRACT, DEFAULT, INVOICE, REPORT, DocType
from foliomill.operators import admission, checks, extract, inference, routing, validate
from foliomill.operators.classify import classify
from foliomill.plans.document_run import run, tables
from foliomill.session import shared_folder
from foliomill.sources.documents import read_text_files

GOOD_INVOICE = {
    "vendor": "Acme", "invoice_number": "7", "line_items": [
        {"description": "Disk", "qty": 2, "unit_price": 3.5, "total": 7.0},
        {"description": "Fan", "qty": "1", "unit_price": 10, "total": 10.01},
    ], "tax": 1.5, "grand_total": 18.5,
}


def outcome(spark, kind, data):
    """{rule: (passed, detail)}, or None where the data cannot be checked."""
    rows = spark.createDataFrame([("j", json.dumps(data))], "job_id string, reply string")
    df = validate.check_type(extract.extract_type(rows, kind, "reply"), kind)
    row = df.select("unusable", "checks").first()
    return None if row.unusable else {c.rule: (c.passed, c.detail) for c in row.checks}


def test_invoice_rules(spark):
    out = outcome(spark, INVOICE, GOOD_INVOICE)
    assert all(passed for passed, _ in out.values()), out  # a line may be off by exactly one cent
    bad = json.loads(json.dumps(GOOD_INVOICE))
    bad["line_items"][0]["total"] = 7.02
    bad["line_items"].append({"description": " DISK ", "qty": 1, "unit_price": 1, "total": 1})
    bad.update(vendor="", grand_total=19.51)
    out = outcome(spark, INVOICE, bad)
    assert out["line_item_math"] == (False, "Line 1: 2.0 x 3.5 = 7.0, but listed as 7.02")
    assert out["no_duplicate_items"] == (False, "Duplicate items: disk")
    assert out["grand_total_correct"] == (False, "Expected 19.5 (subtotal 18.0 + tax 1.5), got 19.51")  # one cent is too much
    assert out["vendor_present"] == (False, "Missing vendor name")


def test_missing_numbers_are_zero_but_null_is_an_error(spark):
    out = outcome(spark, INVOICE, {"line_items": [{"description": "x", "total": 0.0}]})
    assert out["line_item_math"][0] and out["grand_total_correct"][0]
    assert outcome(spark, INVOICE, {**GOOD_INVOICE, "tax": None}) is None
    assert outcome(spark, INVOICE, {**GOOD_INVOICE, "tax": "abc"}) is None
    assert outcome(spark, CONTRACT, {"parties": None}) is None


def test_odd_numbers_and_values(spark):
    """Unread nulls do not count, numbers beyond any table mark their document, empty JSON values are missing."""
    assert outcome(spark, INVOICE, {**GOOD_INVOICE, "total": None})["vendor_present"][0]
    assert outcome(spark, CONTRACT, {"obligations": [{"title": None}]}) is not None
    small = {**GOOD_INVOICE, "line_items": [{"description": "x", "qty": 1_000_000, "unit_price": 0.00123, "total": 1230.0}], "grand_total": 1231.5}
    assert all(passed for passed, _ in outcome(spark, INVOICE, small).values())
    big = {"description": "x", "qty": 1e11, "unit_price": 1e11, "total": 0}
    out = outcome(spark, INVOICE, {**GOOD_INVOICE, "line_items": [big], "grand_total": 2e14})
    assert out["line_item_math"] == (False, "Line 1: 100000000000.0 x 100000000000.0 = 10000000000000000000000.0, but listed as 0.0")
    for odd in ({"qty": 1e17, "unit_price": 1e17}, {"qty": 1e30, "unit_price": 1}, {"total": 1e30}):
        assert outcome(spark, INVOICE, {**GOOD_INVOICE, "line_items": [{**big, **odd}]}) is None
    assert outcome(spark, INVOICE, {**GOOD_INVOICE, "grand_total": 1e30}) is None
    for empty in ({}, [], 0, 0.0, False, "", None):
        assert not outcome(spark, INVOICE, {**GOOD_INVOICE, "vendor": empty})["vendor_present"][0], empty
    for given in ({"a": 1}, [0], 7, 0.5, True, "0", "false", " "):
        assert outcome(spark, INVOICE, {**GOOD_INVOICE, "vendor": given})["vendor_present"][0], given


def test_contract_rules(spark):
    data = {
        "parties": ["A", "B"], "effective_date": "2025-01-15", "expiration_date": None,
        "clauses": [{"title": "Scope", "text": "t"}, {"title": "Design", "text": "t"}],
        "terms": {"termination": "IRREVOCABLE"},
    }
    out = outcome(spark, CONTRACT, data)
    assert out["parties_identified"] == (True, "Found 2 parties")
    assert out["expiration_date_present"] == (False, "Missing expiration date")
    assert out["signature_clause_present"][0]  # "Design" holds "sign", as specified
    assert not out["no_unusual_terms"][0]


def test_report_rules(spark):
    data = {"title": "T", "kpis": [{"name": "a", "value": -5}, {"value": 2e12}, {"name": "c", "value": "-9"}], "sections": []}
    out = outcome(spark, REPORT, data)
    assert out["kpi_values_in_range"][1].startswith("a: negative value (-5); unknown: extremely large value (")
    assert "c:" not in out["kpi_values_in_range"][1]
    assert out["period_present"] == (False, "Missing reporting period")
    assert out["sections_present"] == (False, "No sections extracted")


@pytest.mark.parametrize(
    "reply, requested, n, g, errors",
    [
        ('{"type": "invoice", "confidence": "0.9"}', None, ("invoice", 0.9), ("invoice", 0.9), 0),
        ('{"type": "memo", "confidence": 0.6}', None, ("unknown", 0.0), ("unknown", 0.6), 0),
        ('{"type": "report", "confidence": 1.5}', None, ("report", 1.0), ("report", 1.5), 0),
        ('{"type": "report"}', None, ("report", 0.0), ("report", 0.0), 0),
        ('{"type": "report", "confidence": null}', None, ("unknown", 0.0), ("unknown", 0.0), 1),
        ("no json", None, ("unknown", 0.0), ("unknown", 0.0), 1),
        ("no json", "contract", ("contract", 1.0), ("contract", 1.0), 0),
    ],
)
def test_classify(spark, reply, requested, n, g, errors):
    rows = spark.createDataFrame([(reply, requested, [])], "classify_reply string, requested_type string, errors array<string>")
    for profile, wanted in (("N", n), ("G", g)):
        row = classify(rows, profile=profile).first()
        assert (row.document_type, row.classification_confidence, len(row.errors)) == (*wanted, errors)
        assert row.status == ("failed" if errors and profile == "N" else "classifying")


def test_gates(spark):
    rows = spark.createDataFrame(
        [(0.8, [(True,)], [], "output"), (0.79, [(True,)], [], "review_needed"), (0.9, [(False,)], [], "review_needed"),
         (0.9, [], ["validator: x"], "review_needed"), (0.9, [], [], "output")],
        "c double, checks array<struct<passed: boolean>>, errors array<string>, want string",
    )
    out = rows.select("want", routing.gate_rules(F.col("c"), F.col("checks"), F.col("errors")).alias("got")).collect()
    assert all(r.want == r.got for r in out)
    rows = spark.createDataFrame([(0.7, 0, "output"), (0.7, 1, "mark_review"), (0.69, 0, "mark_review"), (None, 0, "mark_review")], "c double, a int, want string")
    out = rows.select("want", routing.gate_overall(F.col("c"), F.col("a")).alias("got")).collect()
    assert all(r.want == r.got for r in out)


def test_extract_table_and_fields(spark):
    rows = spark.createDataFrame(
        [(1, 'ok ```json\n[{"a": 1, "b": "x"}, 5, {"b": null}]\n```'), (2, '{"a": 1}'), (3, "[]"), (4, "bad")], "id int, reply string"
    )
    out = extract.extract_table(rows, ("a", "b"), keep=("id",)).collect()
    assert sorted((r.id, r.row_no, r.a, r.b) for r in out) == [(1, 0, "1", "x"), (1, 2, None, None)]
    got = {r.id: r.fields for r in extract.extract_fields(rows, ("a", "z")).collect()}
    assert got[2] == {"a": "1", "z": None} and got[4] == {"a": None, "z": None}


def test_failing_model_keeps_rows(spark):
    def load():
        def model(prompts):
            if any("boom" in p for p in prompts):
                raise RuntimeError("no answer")
            return [p.upper() for p in prompts]

        return model

    rows = spark.createDataFrame([("a",), ("boom",), ("b",)], "p string").coalesce(1)
    out = {r.p: (r.reply, r.reply_error) for r in inference.infer(rows, "p", load).collect()}
    assert out == {"a": ("A", None), "boom": (None, "no answer"), "b": ("B", None)}


def test_new_type_needs_no_change_in_the_stages(spark):
    memo = DocType(
        "memo", "author STRING, recipients ARRAY<STRING>",
        lambda d: [checks.Check("author_present", F.coalesce(d.getField("author") != "", F.lit(False)), "ok", "no author")],
        checks.never_broken, shape='{"author", "recipients"}', expert="memo",
    )
    registry = DEFAULT.with_type(memo)
    docs = spark.createDataFrame([("hi",)], "document_text string")
    jobs = admission.init_jobs(docs, F.lit("now")).withColumns(
        {"classify_reply": F.lit('{"type": "memo", "confidence": 0.9}'), "extract_reply": F.lit('{"author": "A"}'),
         "analysis_reply": F.lit('{"summary": "s"}')}
    )
    row = run(jobs, registry=registry).first()
    assert (row.document_type, row.gate, row.memo.author) == ("memo", "output", "A")
    assert replace(memo, name="x").route == "extract_x"


def test_run_with_model_is_stored_once_and_split(spark, tmp_path):
    (tmp_path / "a.txt").write_text("INVOICE\n\nVendor: X total due tax 2024-01-01 $5.00")
    docs = read_text_files(spark, str(tmp_path))
    accepted, refused = admission.admit(docs.withColumn("requested_type", F.lit(None).cast("string")))
    assert refused.count() == 0
    folder = shared_folder(spark, "run")
    for profile in ("N", "G"):
        result = run(admission.init_jobs(accepted, F.lit("now")), inference.keyword_model, profile=profile)
        result.write.parquet(f"{folder}/{profile}")
        out = tables(spark.read.parquet(f"{folder}/{profile}"))
        assert out["jobs"].first().document_type == "invoice"
        assert out["review_queue"].count() == 1 and out["output"].count() == 0
        assert out["checks"].count() >= 2


def test_admission(spark):
    rows = spark.createDataFrame([("t", None), ("", None), ("t", "memo"), ("t", "unknown")], "document_text string, requested_type string")
    accepted, refused = admission.admit(rows)
    assert accepted.count() == 2
    assert sorted(r.reason for r in refused.collect()) == ["empty document_text", "unsupported document_type"]
