"""Benchmark decontamination with a positional inverted index.

Every item is cut into windows of 13 words (a shorter item is one window).  The corpus is counted for the
items' vocabulary, and each window is looked for by its rarest terms: their postings (document, position)
are stored as the index, shifted by the term's place in the item, and intersected - where all of a window's
rare terms agree on the same shift, the window may stand there.  The exact words then decide.  Rare terms
that stand near their places, up to ``SLACK`` words off, are reported as proximity matches.

Everything is DataFrame code.  The tables that grow with the corpus are the documents, read a few times and
never shuffled with their texts, and the postings of rare terms.  Sides made from the benchmark or from
documents with matches are broadcast only after their rows have been counted.

Defined cases: a null or empty text, or one without words, has no words and is clean; items without words or
without an item_id are not looked for; equal items and repeated windows count once per item_id; documents are
told apart by doc_id and a digest of the text, so null, repeated or reused ids are fine and equal rows get
equal results; other columns are not read; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm import common

WINDOW = 13
PROBES = 3  # rarest terms per window
SLACK = 4
SIDE_ROWS = 500_000
KEY = ["_id", "_mix"]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_mix"), text.alias("_text"))


def _worded(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``_words``, the words of ``_text``."""
    first, words = common.words(common.ascii_lower(F.col("_text")))
    return rows.select(*keep, first).select(*keep, words.alias("_words"))


def _same(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the document key, null ids equal; ``b``'s key columns are dropped."""
    b = b.withColumnsRenamed({k: f"{k}_b" for k in KEY})
    joined = a.join(b, F.col("_id").eqNullSafe(F.col("_id_b")) & (F.col("_mix") == F.col("_mix_b")), how)
    return joined.drop("_id_b", "_mix_b")


def windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per item and window: item, item_id, first (word of the item), n, words."""
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")).distinct()
    items = _worded(items, "item_id").where(F.size("_words") > 0).withColumn("item", F.monotonically_increasing_id())
    firsts = F.when(F.size("_words") <= width, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size("_words") - width))
    rows = items.select("item", "item_id", "_words", F.explode(firsts).alias("first"))
    cut = F.slice("_words", F.col("first") + 1, width)
    return common.staged(rows.select("item", "item_id", "first", F.size(cut).alias("n"), cut.alias("words")), "windows")


def _probed(wins: DataFrame, corpus: DataFrame) -> DataFrame:
    """The windows whose words all occur in the corpus, with ``places``: where their rarest terms stand in the item."""
    terms = wins.select("item", "first", F.posexplode("words").alias("at", "term"))
    vocabulary = common.small_side(common.staged(terms.select("term").distinct(), "vocabulary"), SIDE_ROWS)
    # Documents per term: a text's own repeats are dropped before they become rows.
    words = corpus.select(F.explode(F.array_distinct("_words")).alias("term")).join(vocabulary, "term")
    counts = common.staged(words.groupBy("term").count(), "counts")
    each = terms.groupBy("item", "first", "term").agg((F.min("at") + F.col("first")).alias("place")).join(counts, "term", "left")
    rarest = each.groupBy("item", "first").agg(
        F.count_if(F.col("count").isNull()).alias("_absent"),
        F.slice(F.array_sort(F.collect_list(F.struct("count", "term", "place"))), 1, PROBES).alias("_rarest"),
    )
    return common.staged(wins.join(rarest.where("_absent = 0").drop("_absent"), ["item", "first"]), "probes")


def matches(docs: DataFrame, benchmark: DataFrame, proximity: bool = True) -> DataFrame:
    """One row per document key and window that may or does occur: item_id, at (first word), n, kind.

    kind is ``phrase`` (exact) or ``near`` (left out without ``proximity``).
    """
    return _searched(docs, benchmark, proximity)[0]


def _searched(docs: DataFrame, benchmark: DataFrame, proximity: bool) -> tuple[DataFrame, DataFrame]:
    """The matches, and the document keys with n_words, one row per document."""
    keyed = _keyed(docs)
    corpus = _worded(keyed, *KEY)
    probed = _probed(windows(benchmark), corpus)
    lists = probed.select("item", F.explode("_rarest").alias("r")).select("item", F.col("r.term").alias("term"), F.col("r.place").alias("place")).distinct()
    ends = lists.sparkSession.createDataFrame([("",)], "term string")
    wanted = common.small_side(lists.select("term").distinct().unionAll(ends), SIDE_ROWS)
    # The index: postings of every term that some window is looked for by.  No word is empty, so the empty term
    # marks the end of each document.
    ended = F.array_append("_words", F.lit(""))
    index = common.staged(corpus.select(*KEY, F.posexplode(ended).alias("pos", "term")).join(wanted, "term"), "index")
    sizes = index.where("term = ''").select(*KEY, F.col("pos").cast("long").alias("n_words"))
    least = probed.groupBy("item").agg(F.min(F.size("_rarest")).alias("_least"))
    shifted = index.join(common.small_side(lists, SIDE_ROWS), "term").select(*KEY, "item", (F.col("pos") - F.col("place")).alias("shift"), "place")
    hits = shifted.groupBy(*KEY, "item").agg(F.collect_set(F.struct("shift", "place")).alias("_hits"))
    hits = hits.join(common.small_side(least, SIDE_ROWS), "item").where(F.size(F.array_distinct(F.col("_hits.place"))) >= F.col("_least"))
    hits = common.staged(hits, "hits")
    spread = hits.select(*KEY, "item", F.explode("_hits").alias("h")).select(*KEY, "item", "h.shift", "h.place")
    sought = probed.select("item", "item_id", "first", "n", "words", F.col("_rarest.place").alias("_places"))
    covers = F.size(F.array_except("_places", "_found")) == 0

    aligned = spread.groupBy(*KEY, "item", "shift").agg(F.collect_set("place").alias("_found")).join(sought, "item").where(covers)
    phrase = aligned.withColumn("at", F.col("shift") + F.col("first")).where("at >= 0").select(*KEY, "item_id", "at", "n", F.array_join("words", " ").alias("_phrase"))
    phrase = common.staged(phrase, "aligned")
    # Shifts that fall into one of two overlapping bands of 2 * SLACK + 1 are close enough.
    band = 2 * SLACK + 1
    bands = F.array(F.struct(F.lit(0).alias("k"), F.floor(F.col("shift") / band).alias("b")), F.struct(F.lit(1).alias("k"), F.floor((F.col("shift") + SLACK) / band).alias("b")))
    near = spread.select(*KEY, "item", "shift", "place", F.explode(bands).alias("band")).groupBy(*KEY, "item", "band").agg(F.collect_set("place").alias("_found"), F.min("shift").alias("shift"))
    near = near.join(sought, "item").where(covers).select(*KEY, "item_id", F.greatest(F.col("shift") + F.col("first"), F.lit(0)).alias("at"), "n", F.lit("near").alias("kind"))

    owners = phrase.select(*KEY).distinct()
    texts = common.staged(_same(keyed, common.small_side(owners, SIDE_ROWS), "inner").dropDuplicates(KEY), "matched")
    asked = phrase.groupBy(*KEY).agg(F.collect_set(F.struct("item_id", "at", "n", "_phrase")).alias("_asked"))
    worded = _same(_worded(texts, *KEY), asked)
    held = F.filter("_asked", lambda a: F.array_join(F.slice("_words", a["at"] + 1, a["n"]), " ") == a["_phrase"])
    exact = worded.select(*KEY, F.explode(held).alias("m")).select(*KEY, "m.item_id", "m.at", "m.n", F.lit("phrase").alias("kind"))
    return exact.unionByName(near.distinct()) if proximity else exact, sizes


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near."""
    found, sizes = _searched(docs, benchmark, proximity=True)
    found = common.staged(found, "matches")
    exact = found.where("kind = 'phrase'")
    hit = exact.select(*KEY, F.explode(F.sequence("at", F.expr("at + n - 1"))).alias("w")).groupBy(*KEY).agg(F.count_distinct("w").alias("n_hit"))
    items = exact.groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    near = found.groupBy(*KEY).agg(F.count_distinct("item_id").alias("n_near"))
    facts = _same(_same(near, hit, "left"), items, "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return _same(sizes, common.small_side(common.staged(facts, "facts"), SIDE_ROWS), "left").select(
        F.col("_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    found = common.staged(matches(docs, benchmark, proximity=False), "matches")
    hit = found.select(*KEY, F.explode(F.sequence("at", F.expr("at + n - 1"))).alias("w")).groupBy(*KEY).agg(F.count_distinct("w").alias("n_hit"))
    owners = _same(_keyed(docs), common.small_side(hit, SIDE_ROWS))
    bad = _worded(owners, *KEY, "n_hit").where(20 * F.col("n_hit") >= F.size("_words")).select(*KEY).distinct()
    bad = common.small_side(common.staged(bad, "contaminated"), SIDE_ROWS)
    mix = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (mix == bad["_mix"]), "left_anti")


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return judge(common.documents(spark, sf_dir), common.documents(spark, sf_dir, "benchmark")).drop("n_near")


OP10_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '{common.WORD}') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '{common.WORD}') AS w FROM benchmark
), wins AS (
  SELECT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[s:s + least(len(w), {WINDOW}) - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS s FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM wins),
places AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)
), found AS (SELECT DISTINCT doc_id, p.n, s, item_id FROM places p JOIN wins USING (n, phrase)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
