"""Chunks of long documents and the merge of their replies."""

import random

from pyspark.sql import functions as F

from foliomill.doctypes import REPORT
from foliomill.operators import extract, inference, long_documents


def test_chunks_cover_the_text(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "é" * 10, *("".join(rng.choice("abcé \n😀") for _ in range(n)) for n in (9, 10, 11, 17, 18, 19, 400))]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    rows = long_documents.chunks(docs, "body", 10, 3).collect()
    for i, text in enumerate(texts):
        mine = sorted((r.chunk_no, r.n_chunks, r.chunk_text) for r in rows if r.id == i)
        text = text or ""
        want = [text[at : at + 10] for at in range(0, max(len(text) - 3, 1), 7)]
        assert [m[2] for m in mine] == want and [m[0] for m in mine] == list(range(len(want))) and {m[1] for m in mine} == {len(want)}


def test_merge_by_type(spark):
    schema = "id string, chunk_no int, data struct<names: array<string>, date: string, n: bigint, pairs: array<struct<a: string, b: int>>, terms: struct<x: string, y: string>>"
    rows = [
        ("d", 2, (["c", "a"], "late", 7, [("p", 1)], ("x2", "y2"))),
        ("d", 0, (["a", "b"], "", None, None, ("", None))),
        ("d", 1, None),
        ("d", 3, (None, "later", 8, [("p", 2), ("p", 1)], None)),
        ("e", 0, None),
        (None, 0, (["z"], None, None, [], None)),
    ]
    out = long_documents.merge(spark.createDataFrame(rows, schema).repartition(3), ["id"])
    got = {r.id: r for r in out.collect()}
    d = got["d"].data
    assert (d.names, d.date, d.n, [tuple(p) for p in d.pairs], tuple(d.terms)) == (["a", "b", "c"], "late", 7, [("p", 1), ("p", 2)], ("x2", "y2"))
    assert (got["d"].n_chunks, got["d"].n_unreadable) == (4, 1) and (got["e"].data, got["e"].n_unreadable) == (None, 1)
    assert (got[None].data.names, got[None].data.pairs, got[None].data.terms) == (["z"], [], None)


def test_lists_with_variants_keep_their_elements(spark):
    replies = [(1, 0, '{"title": null, "kpis": [{"name": "a", "value": 1}]}'), (1, 1, '{"title": "T", "kpis": [{"name": "a", "value": 1}, {"name": "b", "value": "x"}]}')]
    parsed = extract.extract_type(spark.createDataFrame(replies, "id int, chunk_no int, reply string"), REPORT, "reply")
    row = long_documents.merge(parsed, ["id"]).select(F.to_json("data.title").alias("t"), F.col("data.kpis.name").alias("names")).first()
    assert (row.t, row.names) == ('"T"', ["a", "a", "b"])


def test_replies_are_kept_and_paid_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def load():
        def model(prompts):
            for p in prompts:
                with open(calls / str(len(p)), "a") as f:
                    f.write("x")
            return [f"re {p}" if p != "bad" else None for p in prompts]

        return model

    kept = str(tmp_path / "kept")
    first = spark.createDataFrame([(1, "p"), (2, "pp"), (3, "p"), (4, None)], "id int, prompt string")
    got = inference.infer_once(first, "prompt", load, kept, "run1")
    assert sorted((r.id, r.reply, r.reply_error) for r in got.collect()) == [(1, "re p", None), (2, "re pp", None), (3, "re p", None), (4, "re ", None)]
    more = spark.createDataFrame([(5, "pp"), (6, "ppp")], "id int, prompt string")
    got = inference.infer_once(more, "prompt", load, kept, "run2")
    assert sorted((r.id, r.reply) for r in got.collect()) == [(5, "re pp"), (6, "re ppp")]
    assert {p.name: len(p.read_text()) for p in calls.iterdir()} == {"0": 1, "1": 1, "2": 1, "3": 1}
