"""Quality rules: boosted trees over document statistics, scored as flat node arrays.

Base rules reject documents with fewer than 50 words, or with more than half of the words in repeated
3-word windows.  The rest is judged by gradient-boosted trees (logistic loss) fitted on labelled
documents.  The trees are kept as numpy node arrays and scored for a whole batch at once; splits on
the features in ``FALLING`` may only lower the score as the feature grows.

Defined cases: a null text counts as empty; an empty text has zero counts and fails the base rule; a
null doc_id is kept as null; repeated rows are judged one by one; other columns pass through
``keep_rows`` untouched and never enter the rules; without usable labels (none, or one class only)
the base rules alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm import common

MIN_WORDS = 50
FEATURES = (
    "n_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "bang_share",
    "bar_share", "distinct_share", "mean_line", "digit_share", "stop_share",
)
# More of these never makes a document better.
FALLING = ("symbols_per_word", "dup_line_share", "repeat_share")
TRAIN_ROWS = 4000
_SYMBOLS = b"#*$%&|<>"
_SPACES = b"\t\n\x0b\x0c\r "
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
# Frequent function words of the four languages.
_STOP = frozenset(
    b"the of and to in a is that it for on was as are with the be this by der die und das von mit den zu ein eine "
    b"de la le les et des en un une pour que dans est el los y del las por con su se no".split()
)
STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>"


def _repeats(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    size = len(codes)
    if size < 2_000_000:  # three codes fit one 64-bit key exactly
        keys = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
        keys = pairs[:-1] * size + ids[2:]
    _, first, counts = np.unique(keys, return_inverse=True, return_counts=True)
    hit = counts[first] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + n] |= hit
    return int(covered.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The five contract counts and the features of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split cuts at exactly \x20 and \x09-\x0D
    n = len(words)
    solid = raw.translate(None, _SPACES)
    # Code points: bytes that do not continue a character.
    word_chars = len(solid) if solid.isascii() else int((np.frombuffer(solid, np.uint8) & 0xC0 != 0x80).sum())
    n_symbols = len(solid) - len(solid.translate(None, _SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip(_SPACES)]
    dup = len(lines) - len(set(lines))
    repeat = _repeats(words)
    per = max(n, 1)
    chars = max(word_chars, 1)
    features = [
        float(n), word_chars / per, n_symbols / per, dup / max(len(lines), 1), repeat / per,
        (len(solid) - len(solid.translate(None, _UPPER))) / chars, solid.count(b"!") / per, solid.count(b"|") / per,
        len(set(words)) / per, n / max(len(lines), 1), (len(solid) - len(solid.translate(None, _DIGITS))) / chars,
        sum(w in _STOP for w in words) / per,
    ]
    return [n, word_chars, n_symbols, dup, repeat], features


def base_failed(counts: np.ndarray) -> np.ndarray:
    """counts: one row per document, as ``statistics`` gives them."""
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > 50 * counts[:, 0])


@dataclass
class Trees:
    """All trees as flat arrays; a leaf points to itself, so scoring walks ``depth`` steps for every row."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float
    cut: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.bias + self.value[at].sum(axis=1)

    def good(self, x: np.ndarray) -> np.ndarray:
        return self.margin(x) >= self.cut


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 32) -> Trees:
    """Second-order boosting on quantile bins; ``FALLING`` features are held monotone by bounds on the leaves."""
    signs = np.array([-1 if f in FALLING else 0 for f in FEATURES])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    margin = np.full(len(x), bias)

    def node() -> int:
        k = len(feature)
        for column, start in ((feature, 0), (threshold, 0.0), (left, k), (right, k), (value, 0.0)):
            column.append(start)
        return k

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + 1.0), low, high))

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        k = node()
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None)
        for j, e in enumerate(edges if level < depth and len(rows) >= 10 else ()):
            gs = np.bincount(binned[rows, j], grad[rows], len(e) + 1).cumsum()[:-1]
            hs = np.bincount(binned[rows, j], hess[rows], len(e) + 1).cumsum()[:-1]
            for b in np.flatnonzero((hs > 0.5) & (h - hs > 0.5)):
                a, c = leaf(gs[b], hs[b], low, high), leaf(g - gs[b], h - hs[b], low, high)
                if signs[j] * (c - a) < 0:
                    continue
                whole = leaf(g, h, low, high)
                gain = sum(-(gi * v + 0.5 * (hi + 1.0) * v * v) for gi, hi, v in ((gs[b], hs[b], a), (g - gs[b], h - hs[b], c))) + (g * whole + 0.5 * (h + 1.0) * whole * whole)
                if gain > best[0] + 1e-12:
                    best = (gain, (j, b, (a + c) / 2))
        if best[1] is None:
            value[k] = rate * leaf(g, h, low, high)
            return k
        j, b, middle = best[1]
        goes = binned[rows, j] <= b
        bounds = ((low, high), (low, high)) if not signs[j] else ((middle, high), (low, middle))
        feature[k], threshold[k] = j, float(edges[j][b])
        left[k] = grow(rows[goes], level + 1, *bounds[0])
        right[k] = grow(rows[~goes], level + 1, *bounds[1])
        return k

    def arrays(cut: float) -> Trees:
        return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), depth, bias, cut)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        start = len(feature)
        roots.append(grow(np.arange(len(x)), 0, -4.0, 4.0))
        one = arrays(0.0)
        one.roots, one.bias = np.array([start]), 0.0
        margin = margin + one.margin(x)
    return arrays(0.0)


def _stats_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("features", pa.list_(pa.float64()))])
    for batch in batches:
        both = [statistics(t) for t in batch.column("text").to_pylist()]
        columns = list(zip(*(c for c, _ in both), strict=True)) or [[]] * 5
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), pa.array([f for _, f in both], pa.list_(pa.float64()))], schema=schema)


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees | None:
    """Trees fitted on at most ``rows`` labelled documents, the first in the order of a hash of the id.

    The bound holds for the fit alone; every document is scored.  None without labels of both classes.
    """
    order = F.xxhash64(F.lit("fit"), F.col("doc_id"))
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marked = marked.orderBy(order, "doc_id").limit(rows)
    picked = _input(docs).join(F.broadcast(marked.select(F.col("doc_id").cast("long").alias("doc_id"))), "doc_id", "left_semi")
    stats = picked.mapInArrow(_stats_batches, STATS).join(F.broadcast(marked), "doc_id")
    got = stats.orderBy(order, "doc_id", "n_words", "word_chars").limit(rows).select("quality", "n_words", "n_repeat_words", "features").collect()
    got = [r for r in got if r.n_words >= MIN_WORDS and 2 * r.n_repeat_words <= r.n_words]
    y = np.array([float(r.quality > 0) for r in got])
    if not got or y.min() == y.max():
        return None
    return fit(np.array([r.features for r in got]), y)


def judge(docs: DataFrame, model: Trees | None) -> DataFrame:
    """One row per document: doc_id, the five counts, base_failed, score (a margin), kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _stats_batches(batches):
            counts = np.array([batch.column(k).to_numpy() for k in range(1, 6)]).T
            failed, kept, score = _verdict(counts, batch.column("features").to_pylist(), model)
            yield pa.record_batch([*batch.columns[:6], pa.array(failed), pa.array(score, pa.float64()), pa.array(kept)], names=[*batch.schema.names[:6], "base_failed", "score", "kept"])

    kinds = STATS.rsplit(",", 1)[0] + ", base_failed boolean, score double, kept boolean"
    return _input(docs).mapInArrow(run, kinds)


def _verdict(counts: np.ndarray, features: list, model: Trees | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = counts.reshape(-1, 5)
    failed = base_failed(counts)
    score = model.margin(np.array(features).reshape(-1, len(FEATURES))) if model and len(counts) else np.zeros(len(counts))
    return failed, ~failed & (score >= (model.cut if model else 0.0)), score


def keep_rows(docs: DataFrame, model: Trees | None) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [statistics(t) for t in batch.column("text").to_pylist()]
            kept = _verdict(np.array([c for c, _ in both]), [f for _, f in both], model)[1]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return judge(docs, train(docs, common.documents(spark, sf_dir, "labels")))
