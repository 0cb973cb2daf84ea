"""N-gram Jaccard join with adaptive multi-match prefixes, and the groups its links make.

A document's set holds its distinct 5-word shingles (64-bit fingerprints).  Two documents whose sets have a
Jaccard similarity of 0.75 or more are linked; the links' connected components are returned.

* Equal sets are one node from the start; within a task their postings are written once.
* All sets are ordered alike: shingles not known to be frequent first, then by rising frequency.  Sharing
  three quarters of the larger set means sharing at least l of the first n - ceil(0.75 n) + l shingles, for
  any l.  l is chosen per document by the estimated cost of its candidates: a document whose prefix holds
  frequent shingles gets a longer prefix and must then share more of it.  Towards a set of its size or larger
  a set needs only the shorter prefix of n - ceil(2 * 0.75 n / 1.75) + l, its lead.  A pair has to share the
  smaller l of the two, and as many as bounds on the rest of both sets leave open.
* Large groups of near copies are joined first through hubs, so that their members need not be compared with
  each other: the node with the smallest id among those that share small fingerprints, then the first nodes
  of each prefix list.  After each round the groups are contracted to nodes, so later links are edges between groups.
* The prefix join then emits only pairs of different groups, found by equi-joins.  A pair goes without verification
  only if the parity bits of both sets prove it too different: each shingle flips one of ``64 * PARITY`` bits, so
  two sets differ in at least as many shingles as bits.  All others are verified on whole sets.
* Prefix lists of the same nodes are joined once, with their number as weight.

Frequencies are lossy counts over all documents (a shingle twice in a chunk of a task is counted); only the
``HEAVY`` most frequent are sent to the tasks.  They order the shingles and size l; any order gives the same
links.

Defined cases: a null text, or one without words, has the empty set and is linked with nothing; fewer than five
words make one shingle; documents without doc_id take part and share the component of their group, null if the
whole group has no id; repeated rows get equal results; other columns are not read.  ``one_per_group`` takes rows
with equal doc_id and text for one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.llm import common

WIDTH = 5
PERCENT = 75
SKETCH = 6
HEAVY = 200_000
CHUNK = 500_000  # shingles counted together in a task
WORDS, NODES = 100_000, 50_000  # words and nodes that a Python worker remembers; beyond that it begins anew
MOST_MATCHES = 15  # fits the four bits that postings have for it
VERIFY_COST = 40.0  # of one verification, in postings read
SIDE_ROWS = 2_000_000
HUBS = 4
PARITY = 16  # longs of parity bits of a set
BITS = [f"b{k}" for k in range(PARITY)]
BATCH = 1_000  # rows of texts or sets that a task hands to Python at once
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class _Hashes(dict):
    """Fingerprints of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def shingles(text: str | None) -> np.ndarray:
    """The sorted fingerprints of the distinct shingles of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, \x20, \x09-\x0D only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join([b"short", *words]))], np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    m = n - WIDTH + 1
    x = h[:m] * _FACTORS[0]
    for k in range(1, WIDTH):
        x += (h[k : k + m] ^ (h[k : k + m] >> np.uint64(32))) * _FACTORS[k]
    x ^= x >> np.uint64(31)
    x *= _FACTORS[1]
    x ^= x >> np.uint64(29)
    return np.unique(x)


def least(n: int) -> int:
    """Shingles that a set of n shares at least with any set it is linked to."""
    return (PERCENT * n + 99) // 100


def packed(s: np.ndarray) -> bytes:
    """The upper five bytes of each fingerprint: what verification ships.

    Two different shingles of one pair share them once in 2**40 / (n * n) pairs, and that matters only where one
    shingle decides.
    """
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 5, 8), np.uint8)
    wide[:, 3:] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return wide.view("<u8")[:, 0]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common_n = len(np.intersect1d(a, b))
    return 100 * common_n >= PERCENT * (len(a) + len(b) - common_n)


def _node(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def parity(s: np.ndarray) -> np.ndarray:
    """``PARITY`` longs: bit k tells whether the number of shingles that fall on k is odd."""
    odd = np.bincount((s % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_PROFILE = "doc_id long, mix long, n long, node long, sketch array<long>, token long, seen long, " + ", ".join(f"{b} long" for b in BITS)
_PROFILE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("mix", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sketch", pa.list_(pa.int64())), ("token", pa.int64()), ("seen", pa.int64()), *((b, pa.int64()) for b in BITS)])


def _written(df: DataFrame, purpose: str) -> DataFrame:
    """``common.staged`` with ``BATCH`` rows at most in an Arrow batch: a whole text or set each."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(BATCH if int(before) <= 0 else min(BATCH, int(before))))
    try:
        return common.staged(df, purpose)
    finally:
        conf.set(name, before)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document (token null), and a row per shingle that a chunk has twice or more (n null)."""
    sets: list[np.ndarray] = []
    known: set[int] = set()
    size = 0

    def counted() -> pa.RecordBatch:
        tokens, seen = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_counts=True)
        tokens, seen = tokens[seen > 1].view(np.int64), seen[seen > 1]
        none = pa.nulls(len(tokens), pa.int64())
        return pa.record_batch([none, none, none, none, pa.nulls(len(tokens), pa.list_(pa.int64())), pa.array(tokens, pa.int64()), pa.array(seen, pa.int64()), *[none] * PARITY], schema=_PROFILE_SCHEMA)

    for batch in batches:
        n, nodes, sketches = [], [], []
        bits = np.zeros((batch.num_rows, PARITY), np.int64)
        for text in batch.column("text"):
            s = shingles(text.as_py())
            bits[len(n)] = parity(s)
            n.append(len(s))
            nodes.append(_node(s) if len(s) else None)
            sketches.append(s[:SKETCH].view(np.int64).tolist())
            if len(s) and nodes[-1] not in known:
                known.add(nodes[-1])
                sets.append(s)
                size += len(s)
                if size >= CHUNK:
                    yield counted()
                    sets, size = [], 0
                    known.clear()
        none = pa.nulls(len(n), pa.int64())
        yield pa.record_batch([batch.column("doc_id"), batch.column("mix"), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), none, none, *(pa.array(b) for b in bits.T.copy())], schema=_PROFILE_SCHEMA)
    yield counted()


def lead(n: int, matches: int) -> int:
    """How many of the first shingles of a set of n count towards larger sets: those share more than ``least``."""
    return n - -(-2 * PERCENT * n // (100 + PERCENT)) + matches


def prefix(s: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The prefix of one set and its number of matches l; counts: estimated documents per shingle, 0 if not frequent."""
    order = np.lexsort((s, counts))
    s, counts = s[order], counts[order].astype(float)
    base = len(s) - least(len(s))
    top = min(MOST_MATCHES, least(len(s)))
    reads = np.maximum(counts, 1).cumsum()[lead(len(s), 0) :][:top]  # of the lead for l = 1, 2, ...
    # A candidate needs l of the reads; of short sets, parity bits leave few candidates to verify.
    cost = reads * (1 + VERIFY_COST * min(1.0, (len(s) / (64 * PARITY)) ** 2) / np.arange(1, top + 1))
    matches = int(cost.argmin()) + 1
    return s[: base + matches], matches


def _postings(heavy_tokens: np.ndarray, heavy_counts: np.ndarray):
    names = ["token", "node", "size", "lead", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            tokens, nodes, sizes, leads, rare = [], [], [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py())
                if not len(s) or (node := _node(s)) in known:
                    continue
                known.add(node)
                if len(known) >= NODES:
                    known.clear()
                counts = np.zeros(len(s), np.int64)
                if len(heavy_tokens):
                    at = np.minimum(np.searchsorted(heavy_tokens, s), len(heavy_tokens) - 1)
                    counts = np.where(heavy_tokens[at] == s, heavy_counts[at], 0)
                head, matches = prefix(s, counts)
                tokens.append(head)
                nodes.append(np.full(len(head), node, np.int64))
                sizes.append(np.full(len(head), len(s) * 16 + matches, np.int64))
                leads.append(np.arange(len(head)) < lead(len(s), matches))
                rare.append(np.full(len(head), (counts == 0).sum(), np.int64))
            if tokens:
                yield pa.record_batch([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(leads)), pa.array(np.concatenate(rare))], names=names)

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: set[int] = set()
    for batch in batches:
        nodes, blobs = [], []
        for text in batch.column("text"):
            s = shingles(text.as_py())
            if len(s) and (node := _node(s)) not in known:
                if len(known) >= NODES:
                    known.clear()
                known.add(node)
                nodes.append(node)
                blobs.append(packed(s))
        yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], names=["node", "blob"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [linked(unpacked(x.as_buffer()), unpacked(y.as_buffer())) for x, y in zip(batch.column("blob_a"), batch.column("blob_b"), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _input(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mix"), text.alias("text"))


def verified(docs: DataFrame, profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are linked, by their whole sets."""
    pairs = common.staged(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    # One text for each node that is asked for; the others never leave the scan.
    texts = profiles.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("mix", "doc_id")).alias("k"))
    texts = common.staged(texts.select(F.col("k.mix").alias("_mix"), F.col("k.doc_id").alias("_id")).distinct(), "asked")
    rows = _input(docs).join(common.small_side(texts, SIDE_ROWS), (F.col("mix") == F.col("_mix")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    # Both joins deal the sets out by node: Spark writes that shuffle once and reads it twice.
    sets = rows.mapInArrow(_sets, "node long, blob binary").hint("merge")
    with_b = sets.join(pairs.hint("merge"), F.col("node") == F.col("b")).select("a", "b", F.col("blob").alias("blob_b"))
    both = with_b.hint("merge").join(sets, F.col("a") == F.col("node")).select("a", "b", F.col("blob").alias("blob_a"), "blob_b")
    return _written(both.mapInArrow(_verified, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """node -> label, the smallest node it is connected to; only nodes that have a link.

    Large-star and small-star steps: each moves every edge of a node to its smallest neighbour, until all
    edges end in the label.  Nothing but edges is kept, and every step is written.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = common.staged(edges, "edges")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(low, "u").select(F.explode(moved).alias("e")).select("e.u", "e.v")
        edges = common.staged(small.where("u <> v").distinct(), "edges")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(labels.select("label", "label").distinct())


def contracted(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` with the groups joined that further links connect: only edges between groups are followed."""
    ends = [labels.select(F.col("node").alias(end), F.col("label").alias("_" + end)) for end in "ab"]
    edges = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).distinct()
    moved = components(edges).select(F.col("node").alias("label"), F.col("label").alias("_to"))
    new = moved.select(F.col("label").alias("node"), "label").join(labels, "node", "left_anti")
    return labels.union(new).join(moved, "label", "left").select("node", F.coalesce("_to", "label").alias("label"))


def _hub_pairs(profiles: DataFrame) -> DataFrame:
    """Pairs of a node and the smallest node that shares two of its smallest fingerprints: few per node."""
    nodes = profiles.groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("n").alias("n"))
    each = nodes.select("node", "n", F.explode("sketch").alias("token"))
    hubs = each.groupBy("token").agg(F.min(F.struct("node", "n")).alias("hub"), F.count("*").alias("c")).where("c > 1").select("token", "hub")
    near = each.join(hubs, "token").where("node <> hub.node").where(100 * F.least("n", F.col("hub.n")) >= PERCENT * F.greatest("n", F.col("hub.n")))
    return near.groupBy(F.col("hub.node").alias("a"), F.col("node").alias("b")).count().where("count > 1").select("a", "b")


def _prefix_lists(docs: DataFrame, heavy: DataFrame) -> DataFrame:
    """The lists of nodes that have a shingle in their prefix: token, times, node, size (16 times the set's size, and l), lead, rare.

    rare: the set's shingles that are not known to be frequent; the fewer, the nearer a copy is to its family's common text.

    Shingles that lie in the same prefixes have the same list: one of them stands for all, ``times`` over.
    """
    spark = docs.sparkSession
    known = heavy.toPandas().sort_values("token", key=lambda t: t.to_numpy().view(np.uint64))  # at most HEAVY rows
    tokens, counts = known["token"].to_numpy(np.int64).view(np.uint64), known["seen"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast((tokens, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _postings(*shared.value)(batches)

    postings = _input(docs).select("text").mapInArrow(run, "token long, node long, size long, lead boolean, rare long").repartition("token")
    of_list = Window.partitionBy("token")
    # Lists of one node, or without a lead, go at once.
    ends = {"_low": F.min("node").over(of_list), "_high": F.max("node").over(of_list), "_any": F.max("lead").over(of_list)}
    lists = postings.withColumns(ends).where("_low < _high AND _any").select("token", "node", "size", "lead", "rare", "_low").distinct()
    same = {name: F.bit_xor(F.xxhash64("node", "lead", F.lit(k))).over(of_list) for k, name in enumerate(["_x", "_y"])}
    lists = _written(lists.withColumns(same), "lists")
    kept = lists.where("node = _low").groupBy("_x", "_y").agg(F.min("token").alias("token"), F.count("*").alias("times")).select("token", "times")
    return common.staged(lists.join(kept, "token").select("token", "times", "node", "size", "lead", "rare"), "kept")


def _labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists with each node's group; lists of one group go."""
    of_list = Window.partitionBy("token")
    rows = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return rows.withColumns({"_low": F.min("label").over(of_list), "_high": F.max("label").over(of_list)}).where("_low < _high").drop("_low", "_high")


def _sides(a: Column, b: Column) -> list[Column]:
    """Columns a, b, size_a, size_b of a posting and another one of its list."""
    return [a["node"].alias("a"), b["node"].alias("b"), a["size"].alias("size_a"), b["size"].alias("size_b"), F.col("times")]


def _smaller(a: Column, b: Column) -> Column:
    """Whether a leads and has the smaller set of the two (of equal ones, the smaller node)."""
    return a["lead"] & (F.struct(F.shiftright(a["size"], 4), a["node"]) < F.struct(F.shiftright(b["size"], 4), b["node"]))


def _enough(found: DataFrame) -> DataFrame:
    """a (smaller), b, size_a, size_b, times of the lists that two nodes share -> the pairs that share enough of them."""
    n_a, n_b = F.shiftright("size_a", 4), F.shiftright("size_b", 4)
    # Shared shingles lie in a's lead and b's prefix or behind the one that ends first, which leaves a bound for the rest.
    floor_a = F.expr(f"({2 * PERCENT} * shiftright(size_a, 4) + {99 + PERCENT}) div {100 + PERCENT} - size_a % 16")
    floor_b = F.expr(f"({PERCENT} * shiftright(size_b, 4) + 99) div 100 - size_b % 16")
    overlap = F.ceil(PERCENT * (n_a + n_b) / (100 + PERCENT))
    need = F.greatest(F.lit(1), overlap - F.greatest(floor_a, floor_b))
    counted = found.where(100 * n_a >= PERCENT * n_b).select("a", "b", need.alias("need"), "times").groupBy("a", "b").agg(F.sum("times").alias("n"), F.min("need").alias("need"))
    return counted.where("n >= need").select("a", "b")


def _list_hub_pairs(lists: DataFrame) -> DataFrame:
    """Pairs of a node and the ``HUBS`` first nodes of its lists, by as many orders of all nodes: HUBS rows for each posting.

    One order is by ``rare``: its hubs are linked with most of their family.  The first node of an order is the hub of each of its lists, so its pairs are counted in full.
    """
    of_list = Window.partitionBy("token")
    one = F.struct("node", "size", "lead", "label")
    hubs = F.array(*(F.min(F.struct((F.lit(0) if k else F.col("rare")).alias("first"), F.xxhash64("node", F.lit(k)).alias("turn"), one.alias("hub"))).over(of_list)["hub"] for k in range(HUBS)))
    rows = lists.select("times", one.alias("x"), hubs.alias("_hubs")).select("times", "x", F.explode(F.array_distinct("_hubs")).alias("y")).where("x.label <> y.label")
    x, y = F.col("x"), F.col("y")
    both = F.array(F.when(_smaller(x, y), F.struct(*_sides(x, y))), F.when(_smaller(y, x), F.struct(*_sides(y, x))))
    return _enough(rows.select(F.explode(F.array_compact(both)).alias("p")).select("p.*"))


def _near(x: Column, y: Column) -> Column:
    """False only if the parity bits of two sets show that they differ in too many shingles to be linked."""
    differ = sum((F.bit_count(x[b].bitwiseXOR(y[b])) for b in BITS[1:]), F.bit_count(x[BITS[0]].bitwiseXOR(y[BITS[0]])))
    return (100 + PERCENT) * differ <= (100 - PERCENT) * (F.shiftright(x["size"], 4) + F.shiftright(y["size"], 4))


def _prefix_pairs(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """All pairs of nodes in different groups that share as many shingles of lead and prefix as they must.

    Pairs whose parity bits rule a link out are left in the join.
    """
    bits = nodes.groupBy("node").agg(*(F.first(b).alias(b) for b in BITS))
    sized = lists.withColumn("_n", F.count("*").over(Window.partitionBy("token", "label")))
    sized = sized.withColumn("main", F.max(F.struct("_n", "label")).over(Window.partitionBy("token"))["label"]).drop("_n")
    sized = common.staged(sized.join(bits, "node"), "groups")
    one = F.struct("node", "size", "lead", "label", *BITS)
    # Every pair of two groups has a side outside the largest group of its list.
    leads, others = sized.where("lead").select("token", "times", "main", one.alias("x")), sized.select("token", one.alias("y"), "main")
    x, y = F.col("x"), F.col("y")
    found = [
        leads.where("x.label <> main").drop("main").join(others.drop("main"), "token"),
        leads.where("x.label = main").drop("main").join(others.where("y.label <> main").drop("main"), "token"),
    ]
    # The sizes are compared in the join, before its rows are made.
    fits = (x["label"] != y["label"]) & _smaller(x, y) & (100 * F.shiftright(x["size"], 4) >= PERCENT * F.shiftright(y["size"], 4)) & _near(x, y)
    found = [f.where(fits).select(*_sides(x, y)) for f in found]
    return _enough(found[0].unionAll(found[1]))


def join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, mix (a digest of the text), n_shingles, component (null if unlinked), component_id."""
    base = _written(_input(docs).mapInArrow(_profiles, _PROFILE), "profiles")
    profiles = base.where("token IS NULL")
    heavy = base.where("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen")).where("seen > 2").orderBy(F.desc("seen"), "token").limit(HEAVY)
    nodes = profiles.where("node IS NOT NULL")
    labels = common.staged(components(verified(docs, nodes, _hub_pairs(nodes))), "labels")
    lists = _prefix_lists(docs, heavy)
    # What the lists' hubs join first need not be compared member by member.
    for candidates in (_list_hub_pairs, lambda rows: _prefix_pairs(rows, nodes)):
        more = verified(docs, nodes, candidates(_labelled(lists, labels)))
        if not more.isEmpty():
            labels = common.staged(contracted(labels, more), "labels")
    rows = profiles.select("doc_id", "mix", "n", "node").join(labels, "node", "left").withColumn("component", F.coalesce("label", "node"))
    smallest = rows.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(smallest, "component", "left")
    return out.select("doc_id", "mix", F.col("n").alias("n_shingles"), "component", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group does: the one with the smallest doc_id."""
    rows = common.staged(join(docs), "groups")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mix")
    chosen = rows.where("component IS NOT NULL").groupBy("component").agg(F.min(key).alias("k")).select("k.doc_id", "k.mix")
    alone = rows.where("component IS NULL").select("doc_id", "mix").distinct()
    keys = chosen.union(alone).select(F.col("doc_id").alias("_id"), F.col("mix").alias("_mix"))
    mix = common.fresh(docs, "mix")
    mixed = docs.withColumn(mix, F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))))
    stay = mixed.join(keys.hint("merge"), mixed["doc_id"].eqNullSafe(keys["_id"]) & (mixed[mix] == keys["_mix"]), "left_semi")
    return stay.dropDuplicates(["doc_id", mix]).select(*docs.columns)


def op4_similar(spark, sf_dir: str) -> DataFrame:
    return join(common.documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
