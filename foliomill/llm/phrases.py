"""Phrase collocation mining: count streams in prefix and in suffix order, merged in lockstep.

A text is split at punctuation and line ends into pieces and those into words; everything is per language.

1. *Words.*  Tasks turn blocks of text into arrays of block-local word numbers, each block with its distinct words and
   their counts; the arrays are written once.  Words met often enough get a number of the whole corpus.  No phrase
   can be more frequent than its words, so a rare word ends a piece as far as phrases are concerned.
2. *Count stream.*  Every place gives one window of up to four word numbers, packed into two longs; a block sends
   its distinct windows with their counts.  Sorted, all windows that begin alike stand together, so one pass over the
   sorted stream counts the phrases of two, three and four words as runs.  A run cut by the border of two tasks
   is sent in parts and added up.
3. *Lockstep.*  The frequent phrases are sorted twice, by their words and by their words from last to first.
   In the first order a phrase follows the phrases it begins with (left counts), in the second those it ends with
   (right counts); in both it meets the phrase it extends by one word.  The two streams are merge-joined.

A phrase whose extension has ``share`` percent of its count is dropped.  It suffices to look one word further: what
lies between a phrase and a longer candidate is a candidate itself and at least as frequent as the longer one.

Ranges of the sorted streams are dealt by sampled bounds over whole windows, so neither a word nor a pair that a
third of all rows hold gathers in one task.  Intermediate tables are written below ``spark.checkpoint.dir``.

Defined cases: a null text is an empty one and has no words; a null language is ``und``; repeated rows count each;
a very long text is one block of its own; a table without frequent phrases, or without rows, gives no rows; phrases
tied in score and count are ranked by their UTF-8 bytes; doc_id and other columns are not read.  At most 2**31 - 1
frequent words can be numbered; beyond that the job stops with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.llm import common

# Fixed values of the query.
MIN_COUNT, TOP, SHARE, SCALE = 30, 2000, 80, 2_000_000
LONGEST = 4  # words of a window; two longs hold as many numbers
BLOCK_BYTES = 3 << 20  # text of a block
BUCKETS = 64  # of a language's candidates before the last ranking
LAST = 0xFFFFFFFF

_BLOCK = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("size", pa.int64()), ("ids", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_WINDOW = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("n", pa.int64())])

# Bytes in lower case, and their kind: 0 of a word, 1 blank, 2 end of a piece.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[[*b".,;:!?", *range(10, 14)]] = 2


# --- words ---------------------------------------------------------------------------------


def _tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The word numbers of these texts in order, 0 between pieces, and the words; number k is word k - 1."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or offsets[0] == offsets[-1]:
        return np.zeros(0, np.int32), pa.array([], pa.string())
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    first = np.unique(offsets[:-1] - offsets[0])
    first = first[first < len(raw)]
    kind = _KIND[raw]
    inside = kind == 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[first] = inside[first]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.int32), pa.array([], pa.string())
    stop = kind == 2
    stop[first] = True
    piece = np.searchsorted(np.flatnonzero(stop), starts, side="right")
    close = inside.copy()
    close[:-1] &= ~inside[1:] | begin[1:]
    # Bytes of words only, so the lengths of the words give their offsets.
    letters = _LOWER[raw[inside]]
    spans = np.append(0, np.cumsum(np.flatnonzero(close) + 1 - starts)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(spans), pa.py_buffer(letters)).dictionary_encode()
    shift = np.cumsum(np.diff(piece, prepend=piece[0]) != 0)
    out = np.zeros(len(starts) + int(shift[-1]), np.int32)
    out[np.arange(len(starts)) + shift] = words.indices.to_numpy() + 1
    return out, words.dictionary


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        texts, langs = batch.column(1), batch.column(0).dictionary_encode()
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        codes = langs.indices.to_numpy(zero_copy_only=False)
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            rows = np.flatnonzero(codes == code)
            filled = np.cumsum(sizes[rows]) // BLOCK_BYTES
            for some in np.split(rows, np.flatnonzero(np.diff(filled)) + 1):
                ids, words = _tokens(texts.take(pa.array(some)))
                if not len(ids):
                    continue
                counts = np.bincount(ids, minlength=len(words) + 1)[1:]
                size, packed = len(ids), pa.compress(ids.tobytes(), codec="zstd", asbytes=True)
                del ids
                yield pa.record_batch([[number], [lang], [size], [packed], pa.array([words], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))], schema=_BLOCK)
                number += 1
    pa.default_memory_pool().release_unused()


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of word numbers: block, lang, size, ids (32-bit, packed), words, counts; written to the shared folder."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return common.staged(rows.mapInArrow(_blocks, "block long, lang string, size long, ids binary, words array<string>, counts array<long>"), "phrase-blocks")


def numbered(counts: DataFrame) -> DataFrame:
    """``counts`` written once, with ``gid``: numbers from 1 without gaps, in no particular order."""
    rows = common.staged(counts.withColumn("_at", F.monotonically_increasing_id()), "phrase-words")
    sizes = rows.groupBy((F.col("_at").bitwiseAND(F.lit(-1 << 33))).alias("_part")).agg(F.count("*").alias("_n"))
    # One row per partition of the write.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    gid = F.col("_before") + F.col("_at") - F.col("_part") + 1
    gid = F.when(gid > (1 << 31) - 1, F.raise_error(F.lit("more than 2**31 - 1 frequent words"))).otherwise(gid)
    return rows.withColumn("_part", F.col("_at").bitwiseAND(F.lit(-1 << 33))).join(F.broadcast(sizes), "_part").withColumn("gid", gid).drop("_at", "_part", "_before")


# --- the count stream ------------------------------------------------------------------------


def _windows(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's distinct windows of two to four frequent words, sorted, with counts."""
    out = []
    numbers = np.zeros(int(pc.max(right.column("place")).as_py() or 0) + 2 if right.num_rows else 1, np.int64)
    numbers[right.column("place").to_numpy() + 1] = right.column("gid").to_numpy()
    for size, packed in zip(left.column("size").to_pylist(), left.column("ids"), strict=True):
        ids = np.frombuffer(pa.decompress(packed.as_buffer(), decompressed_size=4 * size, codec="zstd"), np.int32)
        a = np.zeros(size + LONGEST - 1, np.int64)
        known = ids < len(numbers)
        a[:size][known] = numbers[ids[known]]
        a, b, c, d = (a[k : k + size] for k in range(LONGEST))
        keep = np.flatnonzero((a > 0) & (b > 0))
        third = c[keep]
        fourth = np.where(third > 0, d[keep], 0)
        hi, lo = a[keep] << 32 | b[keep], third << 32 | fourth
        order = np.lexsort((lo, hi))
        hi, lo = hi[order], lo[order]
        new = np.flatnonzero(np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))) if len(hi) else np.zeros(0, np.int64)
        out.append(pa.table([hi[new], lo[new], np.diff(np.append(new, len(hi)))], schema=_WINDOW))
    pa.default_memory_pool().release_unused()
    return pa.concat_tables(out) if out else _WINDOW.empty_table()


class _Runs:
    """Counts of equal keys in a sorted stream; the open run is carried from batch to batch."""

    def __init__(self, least: int):
        self.least, self.open, self.first = least, None, True

    def feed(self, hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> list[tuple]:
        if not len(hi):
            return []
        new = np.flatnonzero(np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))
        hi, lo, n = hi[new], lo[new], np.add.reduceat(n, new)
        out = []
        if self.open:
            if self.open[:2] == (hi[0], lo[0]):
                n[0] += self.open[2]
            else:
                out += self._close(self.open)
        self.open = (int(hi[-1]), int(lo[-1]), int(n[-1]))
        if len(hi) > 1 and self.first:
            out.append((int(hi[0]), int(lo[0]), int(n[0])))
            self.first = False
            hi, lo, n = hi[1:], lo[1:], n[1:]
        kept = np.flatnonzero(n[:-1] >= self.least)
        return [*out, *zip(hi[kept].tolist(), lo[kept].tolist(), n[kept].tolist(), strict=True)]

    def _close(self, run: tuple) -> list[tuple]:
        cut, self.first = self.first, False
        return [run] if cut or run[2] >= self.least else []


def _count(least: int):
    """Frequent phrases of a sorted range of windows; the first and the last run of each length in any case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [0, -1 << 32, -1]
        runs = [_Runs(least) for _ in masks]
        for batch in batches:
            hi, lo, n = (batch.column(k).to_numpy() for k in range(3))
            found: list[tuple] = []
            for k, (mask, counter) in enumerate(zip(masks, runs, strict=True)):
                has = slice(None) if k == 0 else lo != 0 if k == 1 else (lo & LAST) != 0
                found += counter.feed(hi[has], lo[has] & mask, n[has])
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=_WINDOW)
        last = [counter.open for counter in runs if counter.open]
        if last:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*last, strict=True)], schema=_WINDOW)

    return run


def frequent(windows: DataFrame, least: int) -> DataFrame:
    """hi, lo, n of the phrases of two to four words that occur ``least`` times."""
    stream = windows.repartitionByRange("hi", "lo").sortWithinPartitions("hi", "lo")
    parts = stream.mapInArrow(_count(least), "hi long, lo long, n long")
    return parts.groupBy("hi", "lo").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# --- the two orders in lockstep ----------------------------------------------------------------


def part(hi: Column, lo: Column, k: int) -> Column:
    """The k-th word number, from 1; 0 beyond the end."""
    word = (hi, hi, lo, lo)[k - 1]
    return F.shiftright(word, 32) if k % 2 else word.bitwiseAND(F.lit(LAST))


def pack(numbers: list[Column]) -> tuple[Column, Column]:
    a, b, c, d = [*numbers, *[F.lit(0).cast("long")] * (LONGEST - len(numbers))]
    return F.shiftleft(a, 32).bitwiseOR(b), F.shiftleft(c, 32).bitwiseOR(d)


def length(hi: Column, lo: Column) -> Column:
    return F.when(lo.bitwiseAND(F.lit(LAST)) != 0, 4).when(lo != 0, 3).when(hi.bitwiseAND(F.lit(LAST)) != 0, 2).otherwise(1)


def _lockstep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hi, lo, m, n in order -> also c1, c2, c3: counts of the phrases of one to three words it begins with.

    All of those are in the stream, each before what begins with it, so the last phrase of k words
    seen is the one.  Null where that one is in an earlier task.
    """
    last = [0] * LONGEST
    for batch in batches:
        m, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        columns = []
        for k in range(1, LONGEST):
            seen = np.maximum.accumulate(np.where(m == k, np.arange(len(m)), -1))
            count = np.where(seen >= 0, n[seen], last[k])
            columns.append(pa.array(count, pa.int64(), mask=(m <= k) | (count == 0)))
            last[k] = int(count[-1])
        yield pa.record_batch([*batch.columns, *columns], names=["hi", "lo", "m", "n", "c1", "c2", "c3"])


def lockstep(phrases: DataFrame, purpose: str) -> DataFrame:
    """``phrases`` (hi, lo, m, n; every beginning of a phrase is in it) with c1, c2, c3; written once."""
    stream = phrases.repartitionByRange("hi", "lo").sortWithinPartitions("hi", "lo")
    rows = common.staged(stream.select("hi", "lo", "m", "n").mapInArrow(_lockstep, "hi long, lo long, m int, n long, c1 long, c2 long, c3 long"), purpose)
    hi, lo = F.col("hi"), F.col("lo")
    keys = [pack([part(hi, lo, j) for j in range(1, k + 1)]) for k in range(1, LONGEST)]
    # Beginnings in an earlier task: at most three different ones per task of the stream.
    open_ = F.filter(F.array(*(F.when(F.col(f"c{k}").isNull() & (F.col("m") > k), F.struct(keys[k - 1][0].alias("hi"), keys[k - 1][1].alias("lo"))) for k in range(1, LONGEST))), lambda s: s.isNotNull())
    cut = rows.select(F.inline(open_)).distinct().join(rows.select("hi", "lo", "n"), ["hi", "lo"])
    cut = common.staged(cut, purpose + "-borders")
    for k in range(1, LONGEST):
        named = cut.select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), F.col("n").alias("_n"))
        here = F.col(f"c{k}").isNull() & (F.col("m") > k) & (keys[k - 1][0] == F.col("_hi")) & (keys[k - 1][1] == F.col("_lo"))
        rows = rows.join(F.broadcast(named), here, "left").withColumn(f"c{k}", F.coalesce(f"c{k}", "_n")).drop("_hi", "_lo", "_n")
    return rows


def turned(phrases: DataFrame) -> DataFrame:
    """The words of each phrase from last to first."""
    hi, lo, m = F.col("hi"), F.col("lo"), F.col("m")
    new = [pack([part(hi, lo, k - j) for j in range(k)]) for k in range(1, LONGEST + 1)]
    pick = lambda side: F.when(m == 1, new[0][side]).when(m == 2, new[1][side]).when(m == 3, new[2][side]).otherwise(new[3][side])
    return phrases.select(pick(0).alias("hi"), pick(1).alias("lo"), *[c for c in phrases.columns if c not in ("hi", "lo")])


def shorter(rows: DataFrame, share: int) -> DataFrame:
    """hi, lo of the phrases without the last word, where the longer one has ``share`` percent of their count."""
    hi, lo, m = F.col("hi"), F.col("lo"), F.col("m")
    base = F.when(m == 3, F.col("c2")).otherwise(F.col("c3"))
    kept = rows.where((m > 2) & (F.col("n").cast("decimal(30,0)") * 100 >= base.cast("decimal(30,0)") * share))
    two, three = pack([part(hi, lo, 1), part(hi, lo, 2)]), pack([part(hi, lo, 1), part(hi, lo, 2), part(hi, lo, 3)])
    return kept.select(F.when(m == 3, two[0]).otherwise(three[0]).alias("hi"), F.when(m == 3, two[1]).otherwise(three[1]).alias("lo"), (m - 1).alias("m"))


# --- the whole ---------------------------------------------------------------------------------


def mine(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, cut: each language's best phrases of two to four words."""
    made = blocks(docs)
    words = made.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select("block", "lang", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    totals = made.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    known = numbered(words.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))
    places = words.select("block", "lang", "place", "word").join(known.select("lang", "word", "gid"), ["lang", "word"]).select(F.col("block").alias("of"), "place", "gid")
    windows = made.select("block", "size", "ids").groupBy("block").cogroup(places.groupBy("of")).applyInArrow(_windows, "hi long, lo long, n long")
    single = known.select(F.shiftleft("gid", 32).alias("hi"), F.lit(0).cast("long").alias("lo"), "n")
    phrases = common.staged(frequent(windows, min_count).unionByName(single).withColumn("m", length(F.col("hi"), F.col("lo"))), "phrases")

    lefts = lockstep(phrases, "phrases-forward")
    rights = lockstep(turned(phrases), "phrases-backward")
    inside = shorter(lefts, share).unionByName(turned(shorter(rights, share))).select("hi", "lo").distinct()
    rights = turned(rights.where("m > 1")).select("hi", "lo", F.col("c1").alias("s1"), F.col("c2").alias("s2"), F.col("c3").alias("s3"))
    both = lefts.where("m > 1").hint("merge").join(rights, ["hi", "lo"]).join(inside.hint("merge"), ["hi", "lo"], "left_anti")

    def cut(k: int, left: str, right: str) -> Column:
        total = F.col(left).cast("decimal(30,0)") + F.col(right).cast("decimal(30,0)")
        return F.struct(F.expr(f"(cast(n as decimal(30,0)) * {SCALE}BD) div (cast({left} as decimal(30,0)) + cast({right} as decimal(30,0)))").alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"), total.alias("_t"))

    cuts = F.when(F.col("m") == 2, F.array(cut(1, "c1", "s1"))).when(F.col("m") == 3, F.array(cut(1, "c1", "s2"), cut(2, "c2", "s1"))).otherwise(F.array(cut(1, "c1", "s3"), cut(2, "c2", "s2"), cut(3, "c3", "s1")))
    best = both.select("hi", "lo", F.col("n").alias("a"), F.array_min(cuts).alias("cut"))
    for k in range(1, LONGEST + 1):
        named = known.select(F.col("gid").alias(f"_g{k}"), F.col("word").alias(f"_w{k}"), *([F.col("lang")] if k == 1 else []))
        best = best.withColumn(f"_p{k}", part(F.col("hi"), F.col("lo"), k)).join(named, F.col(f"_p{k}") == F.col(f"_g{k}"), "left")
    best = best.select("lang", F.concat_ws(" ", "_w1", "_w2", "_w3", "_w4").alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"), F.col("cut.k").alias("cut"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's candidates are ranked in buckets first, so the last ranking has a bounded number of rows.
    best = best.withColumn("_bucket", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)))
    best = best.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_bucket").orderBy(*order))).where(F.col("_r") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "cut")


def op11_phrases(spark, sf_dir: str) -> DataFrame:
    return mine(common.documents(spark, sf_dir))
