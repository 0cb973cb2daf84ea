"""BM25 search, inside each document or over a whole corpus.

Inside a document everything is row-local.  Over a corpus the queries are a table: only postings of
their terms leave a row, dealt by document, so a term that occurs in most documents gathers nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.functions.text import PARAGRAPH_BREAK, TOKEN, paragraphs, tokens
from foliomill.functions.values import computed

# BM25 parameters and the default number of results.
K1, B, TOP_K = 1.5, 0.75, 5
RANK_DIGITS = 9  # scores equal to this many digits are ties, settled by position


def idf(n_docs: Column, df: Column) -> Column:
    return F.ln((n_docs - df + 0.5) / (df + 0.5) + 1.0)


def term_score(idf_value: Column, tf: Column, length: Column, avg_length: Column) -> Column:
    return idf_value * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / avg_length))


# --- inside each document ---------------------------------------------------------------


def search_in_documents(
    docs: DataFrame,
    query: Column | str,
    key: str = "doc_id",
    text: str = "text",
    top_k: int = TOP_K,
    separator: str = PARAGRAPH_BREAK,
) -> DataFrame:
    """Best paragraphs of every document for its query: (key, rank, pos, score, paragraph, fallback).

    Without a query token or without a hit the first ``top_k`` paragraphs are returned with
    ``fallback`` set; an empty text or query returns nothing.
    """
    query = F.lit(query) if isinstance(query, str) else query
    df = computed(docs.select(key, F.col(text).alias("_text"), query.alias("_query")), "_text", "_query")
    df = df.filter((F.col("_text") != "") & (F.col("_query") != ""))
    df = df.withColumns({"_paras": paragraphs(F.col("_text"), separator), "_asked": tokens(F.col("_query"))})
    df = df.drop("_text", "_query").withColumns(
        {"_terms": F.array_distinct("_asked"), "_toks": F.transform("_paras", tokens)}
    )
    df = computed(df, "_paras", "_asked", "_terms", "_toks")
    df = df.withColumns(
        {
            "_len": F.transform("_toks", F.size),
            "_weight": F.transform("_terms", lambda q: F.size(F.filter("_asked", lambda a: a == q))),
            "_tf": F.transform(
                "_toks", lambda t: F.transform("_terms", lambda q: F.size(F.filter(t, lambda x: x == q)))
            ),
        }
    ).drop("_toks", "_asked")
    # What the scoring looks up again and again must be a finished column, not an expression that
    # Catalyst copies into the loop over paragraphs.
    df = computed(df, "_paras", "_terms", "_len", "_weight", "_tf")
    total = F.aggregate("_len", F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    n = F.size("_paras")
    df = df.withColumns(
        {
            "_avg": F.nullif(F.try_divide(total, n), F.lit(0.0)),
            "_idf": F.transform(
                "_terms", lambda _, i: idf(n, F.size(F.filter("_tf", lambda tf: F.get(tf, i) > 0)))
            ),
        }
    )

    df = computed(df, "_avg", "_idf")

    def score(tf: Column, j: Column) -> Column:
        parts = F.transform(
            tf,
            lambda count, i: F.when(
                count > 0,
                F.get("_weight", i) * term_score(F.get("_idf", i), count, F.get("_len", j), F.col("_avg")),
            ).otherwise(0.0),
        )
        return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p)

    df = df.withColumn("_scores", F.transform("_tf", score))
    hits = F.filter(
        F.transform(
            "_scores", lambda s, j: F.struct((-F.round(s, RANK_DIGITS)).alias("order"), j.alias("pos"), s.alias("score"))
        ),
        lambda h: h["score"] > 0,
    )
    df = computed(df.withColumn("_hits", F.slice(F.array_sort(hits), 1, top_k)), "_hits")
    first = F.transform(
        F.slice("_paras", 1, top_k),
        lambda p, j: F.struct(F.lit(-0.0).alias("order"), j.alias("pos"), F.lit(0.0).alias("score")),
    )
    df = df.withColumn("_shown", F.when(F.size("_hits") > 0, F.col("_hits")).otherwise(first))
    return df.select(
        key, (F.size("_hits") == 0).alias("fallback"), "_paras", F.posexplode("_shown").alias("rank", "_hit")
    ).select(
        key,
        (F.col("rank") + 1).alias("rank"),
        (F.col("_hit.pos") + 1).alias("pos"),
        F.col("_hit.score").alias("score"),
        F.get("_paras", F.col("_hit.pos")).alias("paragraph"),
        "fallback",
    )


# --- over a corpus ----------------------------------------------------------------------


def _first_keys(key: str, kind: T.DataType, k: int):
    """Per task: number of texts, sum of their lengths and the k smallest keys of non-empty texts."""
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("total", T.LongType()), T.StructField("first", T.ArrayType(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, first = 0, 0, None
        for batch in batches:
            n += batch.num_rows
            total += pc.sum(batch.column("length")).as_py() or 0
            keys = batch.column(key).filter(batch.column("given"))
            keys = keys if first is None else pa.concat_arrays([first, keys])
            order = pc.sort_indices(keys, null_placement="at_start") if k else pa.array([], pa.int64())
            first = keys.take(order[:k])
        if first is not None:
            lists = pa.ListArray.from_arrays(pa.array([0, len(first)], pa.int32()), first)
            yield pa.record_batch([pa.array([n]), pa.array([total], pa.int64()), lists], names=["n", "total", "first"])

    return run, schema


TIES = 100_000  # rows of equal scores a task keeps before it settles them by key


def _best(query: str, key: str, k: int):
    """Per task: the k best documents of each query, from rows (key, part, asked) in key order.

    ``asked`` lists the (query, place) the part counts for.  Parts of one (query, document) are added in the order of
    places; only the last document of a batch waits for the next one, and what cannot be among the k best is let go.
    """

    def added(rows: pa.Table) -> pa.Table:
        lists = rows.column("asked").combine_chunks()
        counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        asked, keys = lists.flatten(), rows.column("key").combine_chunks()
        row = np.repeat(np.arange(rows.num_rows), counts)
        codes = asked.field("query").dictionary_encode()
        code = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
        # Rows come in key order, so a new document starts where the key changes.
        same = pc.equal(keys[1:], keys[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
        none = keys.is_null().to_numpy(zero_copy_only=False)
        doc = np.concatenate([[0], np.cumsum(~(same | (none[1:] & none[:-1])))])
        part = rows.column("part").to_numpy()[row]
        order = np.lexsort((part, asked.field("place").to_numpy(zero_copy_only=False), code, doc[row]))
        group, part = doc[row][order] * (len(codes.dictionary) + 1) + code[order], part[order]
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(start, len(group)))
        score = np.zeros(len(start))
        for step in range(size.max(initial=0)):
            more = size > step
            score[more] += part[start[more] + step]
        first = order[start]
        return pa.table({"query": asked.field("query").take(first), "key": keys.take(row[first]), "score": score})

    def cut(found: pa.Table) -> pa.Table:
        found = found.filter(pc.greater(found.column("score"), 0.0))
        codes = found.column("query").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        order = np.lexsort((-found.column("score").to_numpy(), codes))
        start = np.flatnonzero(np.concatenate([[True], codes[order][1:] != codes[order][:-1]])) if len(order) else order
        size = np.diff(np.append(start, len(order)))
        # The score of a query's place k; equal ones stay until the end, where the key decides.
        least = np.repeat(found.column("score").to_numpy()[order[start + np.minimum(size, k) - 1]] if len(order) else np.zeros(0), size)
        return found.take(order[found.column("score").to_numpy()[order] >= least])

    def ranked(found: pa.Table) -> pa.Table:
        found = found.take(pc.sort_indices(found, sort_keys=[("query", "ascending"), ("score", "descending"), ("key", "ascending")], null_placement="at_start"))
        codes = found.column("query").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        start = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        return found.filter(np.arange(len(codes)) - np.repeat(start, np.diff(np.append(start, len(codes)))) < k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = best = None

        def kept(rows: pa.Table) -> pa.Table:
            found = added(rows)
            found = cut(found if best is None else pa.concat_tables([best, found]))
            return ranked(found) if found.num_rows > TIES else found

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if waiting is None else pa.concat_tables([waiting, rows])
            keys = rows.column("key").combine_chunks()
            last = keys[len(keys) - 1]
            ends = pc.is_null(keys) if not last.is_valid else pc.equal(keys, last).fill_null(False)
            n = len(keys) - pc.sum(ends).as_py()
            waiting = rows.slice(n)
            if n:
                best = kept(rows.slice(0, n))
        if waiting is not None:
            best = kept(waiting)
        if best is not None and best.num_rows:
            yield from ranked(best).rename_columns([query, key, "score"]).to_batches()

    return run


class Corpus:
    """Search a table of texts with a table of queries, by a join of postings.

    The distinct terms of the queries select the postings; those are dealt by document, so everything about
    a (query, document) pair meets in one task while the queries' terms fit a broadcast (Catalyst decides by
    size; beyond that the join is dealt by term and AQE splits frequent terms).  The plan does not depend on the number
    of queries.  The corpus is read twice: for its size and mean length, and for the postings.

    ``queries`` has one row per query, ``key`` one per document; a null text is an empty one.
    """

    def __init__(self, docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query: str = "query", query_text: str = "text", first: int = TOP_K):
        self.key, self.query, self.first = key, query, first
        self.queries = queries.select(F.col(query), F.coalesce(F.col(query_text), F.lit("")).alias("_asked"))
        self.docs = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
        words = self.queries.select(query, F.posexplode(tokens(F.col("_asked"))).alias("_place", "term"))
        self.asked = words.groupBy(query, "term").agg(F.sort_array(F.collect_list("_place")).alias("_places"))
        self.sizes = self.docs.select(key, F.regexp_count(F.lower("_text"), F.lit(TOKEN)).alias("length"), (F.col("_text") != "").alias("given"))
        self.stats = self.sizes.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("length"), F.lit(1.0)).alias("avg_length"))
        self.hits = self._hits()
        self.frequencies = self._frequencies()

    def _with_first(self) -> DataFrame:
        """One row: n_docs, avg_length, and the first keys of non-empty texts, in one reading."""
        run, schema = _first_keys(self.key, self.docs.schema[self.key].dataType, self.first)
        parts = self.sizes.mapInArrow(run, schema)
        n = F.coalesce(F.sum("n"), F.lit(0))
        firsts = F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, self.first)  # ``first`` keys per task
        return parts.agg(n.alias("n_docs"), F.coalesce(F.sum("total") / F.nullif(n, F.lit(0)), F.lit(1.0)).alias("avg_length"), firsts.alias("first"))

    def summary(self) -> DataFrame:
        return self.stats.select("n_docs", "avg_length")

    def _hits(self) -> DataFrame:
        """(key, length, term, tf) of the queries' terms, dealt by document."""
        df = computed(self.docs.select(self.key, tokens(F.col("_text")).alias("_words")), "_words")
        df = df.select(self.key, F.size("_words").alias("length"), F.explode("_words").alias("term"))
        df = df.join(self.asked.select("term").distinct(), "term", "left_semi").repartition(self.key)
        return df.groupBy(self.key, "length", "term").agg(F.count("*").alias("tf"))

    def _frequencies(self) -> DataFrame:
        """(term, df) of each distinct query term, also of those no document holds."""
        found = self.hits.groupBy("term").agg(F.count("*").alias("df"))
        return self.asked.select("term").distinct().join(found, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))

    def scores(self, stats: DataFrame | None = None) -> DataFrame:
        """(query, key, score) of every document that holds a term of the query."""
        stats = (self.stats if stats is None else stats).select(F.struct("n_docs", "avg_length"))
        found = self.frequencies.where("df > 0").withColumn("_idf", idf(stats.scalar().getField("n_docs"), F.col("df")))
        weights = self.asked.join(found.select("term", "_idf"), "term")
        part = term_score(F.col("_idf"), F.col("tf"), F.col("length"), F.col("_s.avg_length"))
        parts = self.hits.join(weights, "term").withColumn("_s", stats.scalar()).select(self.query, self.key, F.struct("_places", part.alias("_part")).alias("_p"))
        # Added in the order of the query's words, a repeated word each time, so equal documents have equal scores.
        placed = F.flatten(F.transform("_ps", lambda p: F.transform(p["_places"], lambda at: F.struct(at, p["_part"].alias("part")))))
        score = F.aggregate(F.array_sort(placed), F.lit(0.0), lambda acc, p: acc + p["part"])
        return parts.groupBy(self.query, self.key).agg(F.collect_list("_p").alias("_ps")).select(self.query, self.key, score.alias("score")).filter("score > 0")

    def top_k(self, k: int = TOP_K, stats: DataFrame | None = None) -> DataFrame:
        """Best k documents of each query, equal scores by key.  Each task keeps its own k best before the shuffle."""
        best = Window.partitionBy(self.query).orderBy(F.desc("score"), F.col(self.key))
        return self._best_per_task(k, stats).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def _best_per_task(self, k: int, stats: DataFrame | None = None) -> DataFrame:
        """(query, key, score) as in ``scores``, of each task's k best documents per query.

        A posting meets its term's list of queries, so the rows that are moved and sorted are postings, not pairs of a
        query and a document: these are added and dropped in the task.
        """
        parts = self._parts(stats)
        kind = T.StructType([self.queries.schema[self.query], self.docs.schema[self.key], T.StructField("score", T.DoubleType())])
        rows = parts.repartition(self.key).sortWithinPartitions(self.key).select(F.col(self.key).alias("key"), F.col("_part").alias("part"), F.col("_at").alias("asked"))
        return rows.mapInArrow(_best(self.query, self.key, k), kind)

    def _parts(self, stats: DataFrame | None = None) -> DataFrame:
        """(key, part, at): the score of one posting, and the (query, place) it counts for."""
        stats = (self.stats if stats is None else stats).select(F.struct("n_docs", "avg_length"))
        found = self.frequencies.where("df > 0").withColumn("_idf", idf(stats.scalar().getField("n_docs"), F.col("df")))
        places = self.asked.select("term", self.query, F.explode("_places").alias("_place"))
        lists = places.groupBy("term").agg(F.collect_list(F.struct(F.col(self.query).alias("query"), F.col("_place").alias("place"))).alias("_at"))
        part = term_score(F.col("_idf"), F.col("tf"), F.col("length"), F.col("_s.avg_length"))
        return self.hits.join(lists.join(found.select("term", "_idf"), "term"), "term").withColumn("_s", stats.scalar()).select(self.key, part.alias("_part"), "_at")

    def top_k_or_first(self, k: int = TOP_K) -> DataFrame:
        """Like ``top_k``, but a query without token or hit gets the first documents (at most ``first`` of them).

        Empty queries and empty texts return nothing.
        """
        if k > self.first:
            raise ValueError("build the corpus with first=k")
        stats = self._with_first()
        found = self.top_k(k, stats)
        asked = self.queries.filter("_asked <> ''").select(self.query)
        firsts = F.transform(F.slice("_first", 1, k), lambda d, i: F.struct(d.alias(self.key), F.lit(0.0).alias("score"), (i + 1).alias("rank"), F.lit(True).alias("fallback")))
        # One list of hits per query, k long at most: what has none gets the first documents.
        hits = found.groupBy(self.query).agg(F.collect_list(F.struct(self.key, "score", "rank", F.lit(False).alias("fallback"))).alias("_hits"))
        both = asked.join(hits, self.query, "left").withColumn("_first", stats.select("first").scalar())
        both = both.withColumn("_shown", F.coalesce("_hits", firsts))
        return both.select(self.query, F.inline("_shown"))
