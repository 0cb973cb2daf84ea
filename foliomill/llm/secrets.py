"""Secret scans: fixed patterns, and a battery of randomness tests with control of false discoveries.

Base spans come from three patterns (assign, access, hex).  Of any other run of key characters the parts
outside the base spans are cut at ``=``, which stands as padding at the end of a run only.  In each part the
longest stretches of 20 or more characters without ``-_``, without ``+/`` and without any sign are candidates, so a
key is also tried without a name, path or prefix glued to it.  A candidate is tested as a string of its inferred
encoding (decimal, hex, base32, base64, url base64); of overlapping ones the strongest stand, their p-values
multiplied by the number of candidates that overlap.  Three tests hold it against uniform random characters: chi-squared over the alphabet, runs about
the median code, and lag-one serial correlation; a run that fails one of them is no secret.  What remains
gets a p-value under the other hypothesis, that its characters are distributed as in words, from two tests
joined by Fisher's rule: chi-squared, whose expected value under words grows with length, so that the same
uniformity is stronger evidence in a longer run, and runs of character classes.
Benjamini-Hochberg limits the share of false discoveries, per length class, over all runs of all documents;
its thresholds come from a histogram of fixed size.

Defined cases: a null text counts as empty; an empty text has no spans and the digest of the empty string;
offsets are code points, ends exclusive; rows with null or repeated doc_ids are judged one by one; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm import common

# The base patterns.  ASCII, as letters outside it must not match in either case.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
STRETCHES = tuple(re.compile(rf"[A-Za-z0-9{signs}]{{20,}}(?:=+(?![A-Za-z0-9+/_=-]))?") for signs in ("+/", "_-", ""))
ENCODINGS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("hex_upper", "0123456789ABCDEF"),
    ("base32", "234567ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base64", "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64url", "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"),
)
_CODES = [{c: i for i, c in enumerate(a)} for _, a in ENCODINGS]
# Sum of squared and of cubed letter frequencies of words.
WORD_P2, WORD_P3 = 0.066, 0.0056
WORD_CHANGE = 0.2  # share of neighbours of different character class in words, identifiers and paths
LENGTHS = (20, 32, 48, 96)  # length classes begin here
BINS = 400  # of -10 ln p, the last open
FALSE_DISCOVERIES = 0.01
REJECT_UNIFORM = 0.001

_ROW = "doc_id long, base array<struct<start:long,kind:int,end:long>>, runs array<struct<start:long,kind:int,end:long,cls:int,bin:int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def evidence(run: str) -> float | None:
    """p-value of ``run`` under words, or None if the battery rejects uniform random characters."""
    run = run.rstrip("=")
    n, seen = len(run), set(run)
    at = next((i for i, code in enumerate(_CODES) if seen <= code.keys()), None)
    if at is None or n < LENGTHS[0] or ENCODINGS[at][0] == "decimal":
        return None
    codes = np.fromiter(map(_CODES[at].__getitem__, run), np.int64, n)
    k = len(_CODES[at])
    chi = k / n * float((np.bincount(codes, minlength=k) ** 2.0).sum()) - n
    z_chi = (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    above = codes >= k / 2
    a = int(above.sum())
    b = n - a
    if not a or not b:
        return None
    runs = 1 + int((above[1:] != above[:-1]).sum())
    mean = 2 * a * b / n + 1
    z_runs = (runs - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    centred = codes - codes.mean()
    z_serial = float((centred[1:] * centred[:-1]).sum() / (centred**2).sum()) * math.sqrt(n)
    if min(_tail(z_chi), 2 * _tail(abs(z_runs)), 2 * _tail(abs(z_serial))) < REJECT_UNIFORM / 3:
        return None
    # Under words the expected chi-squared grows with n; its spread as well.
    expected = (n - 1) * (k * WORD_P2 - 1) + (k - 1) if k * WORD_P2 > 1 else (n - 1) + (k - 1)
    spread = math.sqrt(4 * n * k * k * (WORD_P3 - WORD_P2**2) + 2 * (k - 1) * max(k * WORD_P2, 1.0) ** 2)
    p_chi = _tail((expected - chi) / spread)
    # Words seldom change between lower case, upper case, digits and signs; random keys do all the time.
    classes = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in run]
    changes = sum(x != y for x, y in zip(classes, classes[1:], strict=False))
    p_class = _tail((changes - (n - 1) * WORD_CHANGE) / math.sqrt((n - 1) * WORD_CHANGE * (1 - WORD_CHANGE)))
    joint = -math.log(max(p_chi, 1e-300)) - math.log(max(p_class, 1e-300))  # Fisher, two tests
    return math.exp(-joint) * (1 + joint)


def outside(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of the runs of ``text`` outside ``spans`` (sorted)."""
    k, covered = 0, 0
    for m in RUN.finditer(text):
        at = max(m.start(), covered)
        while k < len(spans) and spans[k][0] < m.end():
            s, _, e = spans[k]
            if s > at:
                yield at, s
            at, covered, k = max(at, e), max(covered, e), k + 1
        if at < m.end():
            yield at, m.end()


def candidates(text: str, start: int, end: int) -> list[tuple[int, int, float]]:
    """(start, end, p-value) of the strongest stretches of one part, which do not overlap."""
    found, out, group, reach = sorted({m.span() for rx in STRETCHES for m in rx.finditer(text, start, end)}), [], [], 0
    for s, e in [*found, (end + 1, end + 1)]:
        if group and s >= reach:
            tested = [(p, a - b, a, b) for a, b in group if (p := evidence(text[a:b])) is not None]
            taken: list[tuple[int, int]] = []
            for p, _, a, b in sorted(tested):
                i = bisect(taken, (a, b))
                if (not i or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b):
                    taken.insert(i, (a, b))
                    out.append((a, b, min(1.0, p * len(group))))
            group = []
        group.append((s, e))
        reach = max(reach, e)
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    run_type = pa.struct([*span, pa.field("cls", pa.int32()), pa.field("bin", pa.int32())])
    for batch in batches:
        base, runs = [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            spans = base_spans(text)
            mine = []
            for part in outside(text, spans):
                for start, end, p in candidates(text, *part):
                    cls = sum(len(text[start:end].rstrip("=")) >= x for x in LENGTHS) - 1
                    mine.append({"start": start, "kind": 3, "end": end, "cls": cls, "bin": min(BINS - 1, int(-10 * math.log(max(p, 1e-300))))})
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            runs.append(mine)
        yield pa.record_batch([batch.column("doc_id"), pa.array(base, pa.list_(span)), pa.array(runs, pa.list_(run_type))], names=["doc_id", "base", "runs"])


def thresholds(counts: dict[tuple[int, int], int], rate: float = FALSE_DISCOVERIES) -> list[int]:
    """Per length class, the least bin whose runs are discoveries (Benjamini-Hochberg on the histogram)."""
    least = []
    for cls in range(len(LENGTHS)):
        tests = sum(n for (c, _), n in counts.items() if c == cls)
        cut, found = BINS, 0
        for b in range(BINS - 1, -1, -1):
            found += counts.get((cls, b), 0)
            if found and math.exp(-b / 10) * tests <= rate * found:  # every p in bin b is at most exp(-b / 10)
                cut = b
        least.append(cut)
    return least


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts per kind, base_sha256, spans; the spans as structs in found."""
    rows = common.staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, _ROW), "secrets")
    # At most classes x bins rows.
    found = rows.select(F.explode("runs").alias("r")).groupBy("r.cls", "r.bin").count().collect()
    least = thresholds({(r["cls"], r["bin"]): r["count"] for r in found})
    passing = F.filter("runs", lambda r: r["bin"] >= F.element_at(F.array(*map(F.lit, least)), r["cls"] + 1))
    plain = F.transform(passing, lambda r: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end")))
    names = F.array(*map(F.lit, KINDS))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def n(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    every = F.array_sort(F.concat("base", plain))
    return rows.withColumn("found", every).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), "found",
    )


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir)).drop("found")


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
