import re

import numpy as np
from pyspark.sql import functions as F

from foliomill.llm import quality

ODD = [None, "", " \n\t", "a", "a b", "a b c a b c", "x x x x x", "é ü\u00a0z # $ |\n# $ |\n\n# $ |", "a\x1cb \x85 c", "w " * 5000, "\U0001f600 <&> \U0001f600"]


def reference_counts(text: str | None) -> list[int]:
    """The contract's five counts, spelled out for tests."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)]


def test_counts_equal_the_plain_form(spark):
    import random

    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab cd#\n |é") for _ in range(rng.randrange(400))) for _ in range(60)]
    for text in texts:
        assert quality.statistics(text)[0] == reference_counts(text)


def test_trees_learn_and_stay_monotone():
    rng = np.random.default_rng(3)
    x = rng.random((600, len(quality.FEATURES)))
    j = quality.FEATURES.index("symbols_per_word")
    y = ((x[:, j] < 0.6) ^ (rng.random(600) < 0.1)).astype(float)
    y[x[:, j] > 0.9] = 1.0  # against the constraint
    model = quality.fit(x, y)
    assert ((model.margin(x) >= 0) == (x[:, j] < 0.6)).mean() > 0.85
    for row in x[:40]:
        line = np.repeat(row[None], 50, axis=0)
        line[:, j] = np.linspace(0, 1, 50)
        assert (np.diff(model.margin(line)) <= 1e-12).all()


def test_whole_run(spark):
    from conftest import SMALL

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = quality.judge(docs, model).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    judged = [(r.kept, truth[r.doc_id]) for r in rows if r.doc_id in truth and not r.base_failed]
    assert sum(k == bool(t) for k, t in judged) >= 0.97 * len(judged)
    kept = quality.keep_rows(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)


def test_odd_tables(spark):
    rows = [(i if i % 3 else None, t, 7) for i, t in enumerate(ODD)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int").withColumn("features", F.lit("x"))
    got = quality.judge(docs, None)
    assert got.count() == len(rows) and got.columns[:2] == ["doc_id", "n_words"]
    assert quality.keep_rows(docs.limit(0), None).count() == 0
    assert quality.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")) is None
    assert quality.judge(docs.limit(0), None).collect() == []


def test_few_labels_of_both_classes_are_fitted(spark):
    texts = ["".join(f"word{i}x{k} " for k in range(60 + i)) for i in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert model is not None
    assert all(r.score is not None for r in quality.judge(docs, model).collect())
    assert quality.train(docs, labels.where("quality = 1")) is None
    two = quality.train(docs, labels.where("doc_id < 2"))
    assert two is not None and quality.judge(docs, two).count() == 6
