"""Phrase mining against plain counting."""

from __future__ import annotations

import collections
import random
import re

import pytest

from foliomill.llm import common, phrases

PIECE, WORD = re.compile(r"[.,;:!?\n-\r]"), re.compile(r"[^ \t]+")
LOW = str.maketrans(common.UPPER, common.LOWER)


def plain(rows, least, top=2000):
    """(lang, rank, phrase, a, l, r, n, score, cut) by counting every phrase of every piece in dictionaries."""
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in PIECE.split((text or "").translate(LOW)):
            words = WORD.findall(piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {g: a for g, a in f.items() if a >= least and len(g) > 1}
        inside = {g[i : i + k] for g, a in found.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * a >= 80 * f[g[i : i + k]]}
        best = []
        for g, a in found.items():
            if g not in inside:
                score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
                best.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]], k))
        out += [(lang, rank, p.decode(), -a, left, right, total[lang], -s, k) for rank, (s, a, p, left, right, k) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def mined(spark, rows, least, **kw):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    return sorted(tuple(r) for r in phrases.mine(docs, min_count=least, **kw).collect())


@pytest.fixture
def many_ranges(spark):
    """Small sorted streams are cut into ranges, too."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_random_texts_cut_into_ranges(spark, many_ranges):
    draw = random.Random(7)
    words = ["a", "b", "C", "ab", "é", "x\x01", "naïve", "\x00"]
    rows = [(draw.choice(["en", "de", None, ""]), "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t", ". ", "\n", ", "]) for _ in range(draw.randrange(200)))) for _ in range(60)]
    want = plain(rows, 3)
    assert len(want) > 300
    assert mined(spark, rows, 3) == want


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert mined(spark, rows, 3, top=150) == plain(rows, 3, top=150)


def test_copies_long_text_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 64)
    rows = [("en", "one two three four five six")] * 40 + [("en", "two three " * 5000)] + [("en", None), (None, ""), ("en", " . ! ")]
    assert mined(spark, rows, 30) == plain(rows, 30)


def test_odd_tables(spark):
    assert mined(spark, [], 1) == []
    assert mined(spark, [("en", None), (None, "")], 1) == []
    assert mined(spark, [("en", "single words. only! here?")], 2) == []
    wide = spark.createDataFrame([("en", "a b", 1, 2, "x")] * 3, "lang string, text string, block long, hi long, words string")
    got = phrases.mine(wide, min_count=3).collect()
    assert [tuple(r) for r in got] == plain([("en", "a b")] * 3, 3)


def test_counts_beyond_64_bits_stay_exact(spark):
    """The score's product passes 64 bits long before the counts do."""
    big = spark.createDataFrame([(9_000_000_000_000_000_000, 9_000_000_000_000_000_000, 9_000_000_000_000_000_000)], "n long, c1 long, s1 long")
    got = big.selectExpr(f"(cast(n as decimal(30,0)) * {phrases.SCALE}BD) div (cast(c1 as decimal(30,0)) + cast(s1 as decimal(30,0)))").first()[0]
    assert got == 1_000_000
