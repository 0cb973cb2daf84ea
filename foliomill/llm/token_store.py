"""Token-id output: blocks of concatenated ids with Elias-Fano document boundaries.

A token store is a folder of Parquet files, one row per block.  A block holds consecutive documents in
ascending doc_id order, about ``BLOCK_IDS`` ids (one longer document makes a longer block):

========== ======= ===========================================================================
segment    int     place of the sorted range the block belongs to
first_id   long    ids of the segment before this block
n_docs     int     documents in the block
n_ids      int     ids in the block
doc_ids    array   their doc_ids
low_bits   int     Elias-Fano: bits per boundary kept verbatim
lows       binary  those bits, packed
highs      binary  the upper parts as gaps in unary
samples    binary  select structure: bit place of every 64th boundary in ``highs``, 32-bit little-endian
ids        binary  the ids, 16-bit little-endian (32-bit where the vocabulary needs it, see ``width``)
========== ======= ===========================================================================

Boundaries are the n + 1 offsets 0 .. n_ids in the id array; ``EliasFano.select(k)`` gives the k-th without
reading the others, in about 2 + log2(n_ids / n_docs) bits per document instead of 64.  Blocks are written by
Spark, so a lost task leaves nothing behind and a repeated one writes the same.

Defined cases: a null text is an empty text and holds the end id alone; null doc_ids come first; equal doc_ids
are ordered by a digest of the text; repeated rows are stored each; other columns are not read; an empty table
makes an empty store.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.llm import common

BLOCK_IDS = 1 << 16
SAMPLE = 64
END_ID = 2
CACHE = 500_000  # distinct chunks a Python worker remembers

BLOCK = (
    "segment int, first_id long, n_docs int, n_ids int, width int, doc_ids array<long>, low_bits int, lows binary, "
    "highs binary, samples binary, ids binary"
)
# Words end before a space in the byte-level pattern, whatever stands next to them, so these chunks can be encoded
# alone: letters that only signs and then a blank follow, other runs of non-blanks, runs of blanks but the last.
CHUNK = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[^\s\w']*+(?:\s|$))| ?\S++|\s+(?!\S)|\s+")
# Blanks for Python and not for the tokenizer.
ODD_BLANKS = "\x1c\x1d\x1e\x1f"


class EliasFano:
    """A non-decreasing sequence of n numbers below 2**32, with constant-time select."""

    def __init__(self, n: int, low_bits: int, lows: bytes, highs: bytes, samples: bytes):
        self.n, self.low_bits, self.lows, self.highs = n, low_bits, lows, highs
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        low_bits = max(0, int(values[-1] // n).bit_length() - 1) if n else 0
        places = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        low = (values[:, None] >> np.arange(low_bits)) & 1
        return cls(n, low_bits, np.packbits(low.astype(np.uint8), bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4").tobytes())

    def _low(self, k: int) -> int:
        start = k * self.low_bits
        chunk = int.from_bytes(self.lows[start // 8 : (start + self.low_bits) // 8 + 1], "little")
        return chunk >> (start % 8) & ((1 << self.low_bits) - 1)

    def select(self, k: int) -> int:
        """The k-th number: from the sampled place, at most SAMPLE ones further on."""
        at = int(self.samples[k // SAMPLE])
        left = k % SAMPLE
        byte = at // 8
        word = self.highs[byte] >> (at % 8) << (at % 8)
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = self.highs[byte]
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return (place - k) << self.low_bits | self._low(k)

    def values(self) -> np.ndarray:
        """All numbers at once."""
        bits = np.unpackbits(np.frombuffer(self.highs, np.uint8), bitorder="little")
        high = np.flatnonzero(bits)[: self.n] - np.arange(self.n)
        if not self.low_bits:
            return high
        low = np.unpackbits(np.frombuffer(self.lows, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return (high << self.low_bits) | (low.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)


class Encoder:
    """Ids of whole texts by the tokenizers library; chunks that the pattern cannot join are encoded once."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.chunked = spec["normalizer"] is None and spec["post_processor"] is None and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        # A byte-level token has one character for each of its bytes.
        names = (self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size()))
        self.bytes_of = np.fromiter(map(len, names), np.int64) if self.chunked else None

    def _learn(self, new: list[str]) -> None:
        """The ids of new chunks; those of the form blank and word are encoded as one text and cut at their ends."""
        words = [c for c in new if len(c) > 1 and c[0] == " " and not c[1].isspace()]
        ids = np.frombuffer(self._raw(["".join(words)])[0], self.type)
        ends, want = self.bytes_of[ids].cumsum(), np.fromiter((len(c.encode()) for c in words), np.int64, len(words)).cumsum()
        at = np.searchsorted(ends, want)
        if len(words) and at[-1] < len(ends) and (ends[at] == want).all():
            blob, size = ids.tobytes(), self.type.itemsize
            cuts = [0, *((at + 1) * size).tolist()]
            self.known.update((c, blob[s:e]) for c, s, e in zip(words, cuts, cuts[1:], strict=False))
            new = [c for c in new if c not in self.known]
        self.known.update(zip(new, self._raw(new), strict=True))

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian."""
        if not self.chunked:
            return self._raw(texts)
        plain = [not any(c in t for c in ODD_BLANKS) and not any(s in t for s in self.special) for t in texts]
        lists = [CHUNK.findall(text) if fits else None for text, fits in zip(texts, plain, strict=True)]
        used = set().union(*(chunks for chunks in lists if chunks))
        new = used.difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known, new = {}, used
        if new:
            self._learn(list(new))
        find = self.known.__getitem__
        return [self._raw([text])[0] if chunks is None else b"".join(map(find, chunks)) for text, chunks in zip(texts, lists, strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _blocks(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = encoder(path)
        end = np.array([end_id], enc.type).tobytes()
        segment = TaskContext.get().partitionId()
        names: list = []
        parts: list[bytes] = []
        size = first = 0

        def block() -> dict:
            lengths = np.array([0, *map(len, parts)]) // enc.type.itemsize
            ef = EliasFano.build(lengths.cumsum())
            return {"segment": segment, "first_id": first, "n_docs": len(names), "n_ids": size, "width": enc.type.itemsize, "doc_ids": names, "low_bits": ef.low_bits,
                    "lows": ef.lows, "highs": ef.highs, "samples": ef.samples.tobytes(), "ids": b"".join(parts)}

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for at in range(0, len(ids), 256):
                for doc_id, got in zip(ids[at : at + 256], enc.encode([t or "" for t in texts[at : at + 256].to_pylist()]), strict=True):
                    names.append(doc_id)
                    parts.append(got + end)
                    size += len(parts[-1]) // enc.type.itemsize
                    if size >= BLOCK_IDS:
                        yield pa.RecordBatch.from_pylist([block()], schema=_SCHEMA)
                        first, size, names, parts = first + size, 0, [], []
        if names:
            yield pa.RecordBatch.from_pylist([block()], schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([
    ("segment", pa.int32()), ("first_id", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int32()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
    ("low_bits", pa.int32()), ("lows", pa.binary()), ("highs", pa.binary()), ("samples", pa.binary()), ("ids", pa.binary()),
])


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """The ids of all documents, each with the end id, as a token store in ``folder``."""
    order = ["doc_id", "_mix"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("_mix", F.xxhash64("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select("doc_id", "text").mapInArrow(_blocks(tokenizer_path, end_id), BLOCK).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks, with ``start``: ids of all segments and blocks before."""
    blocks = spark.read.schema(BLOCK).parquet(folder)
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the write: bounded by the number of partitions.
    sizes = blocks.groupBy("segment").agg(F.sum("n_ids").alias("_n")).select("segment", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return blocks.join(F.broadcast(sizes), "segment").withColumn("start", F.col("_before") + F.col("first_id")).drop("_before")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            b = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            ends = EliasFano(b["n_docs"] + 1, b["low_bits"], b["lows"], b["highs"], b["samples"]).values()
            wide = memoryview(np.frombuffer(b["ids"], f"<u{b['width']}").astype("<u4").tobytes())
            crc = [zlib.crc32(wide[4 * s : 4 * e]) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.record_batch([pa.array(b["doc_ids"], pa.int64()), pa.array(b["start"] + ends[:-1], pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(blocks: DataFrame) -> DataFrame:
    """One row per document, from the blocks: doc_id, start, n_tokens, ids_crc32."""
    return blocks.mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_store(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.scratch(spark, "tokens")
    write(common.documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return checksums(read(spark, folder))
