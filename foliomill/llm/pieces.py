"""SentencePiece encoding and decoding over a relational lattice.

A text is blank-escaped (every space a U+2581, one in front) and cut into units wherever two neighbouring
characters stand together in no piece: no piece crosses such a place, so the best path of the text is the
best paths of its units, one after the other.  Each distinct unit is encoded once:

1. its substrings of up to the longest piece's length are exploded,
2. joined to the piece table by equality: the edges of the lattice (a character without piece has an edge
   for its bytes),
3. grouped by unit and folded, in the order of their ends, by a higher-order ``aggregate`` that keeps the best
   score and last edge for every end (Viterbi); a second one walks back from the end.

The ids return to the blocks of documents that asked for them, where texts are put together.  Of equal scores
the path whose last piece starts first is taken, as in the unigram model of the library.

The scores of a BPE model are merge ranks and no log probabilities.  With ``rule="model"`` the units of such a
model, as the given file is one, skip steps 1 to 3: each distinct unit is merged in the order of its scores, of
equal ones the leftmost first, so the ids are those of the library for the file as given.  ``rule="scores"`` takes
the best path by the scores whatever the model's type.

Documents are packed into compressed blocks of about ``BLOCK_BYTES`` of text, dealt out by their place in the
input; the shuffle of the blocks is written once and read by both branches.  Units longer than ``LONG``
characters are folded by the same rule in the task that meets them, as arrays of that length would be copied for
every step of the aggregate.  In the tasks, about ``GROUP`` characters of text are cut, looked up and decoded together
as arrays; a block's units are Arrow arrays there and never strings of Python, which took several times the memory.

Defined cases: null and empty texts have no ids and are given back as empty; characters without piece become
their UTF-8 bytes; null and repeated doc_ids and equal rows are encoded one by one; other columns are not read;
texts of any length are encoded whole; an empty table gives an empty result; a model with other types of
pieces than normal, byte, control and unknown, or with pieces across the start of a word, is refused.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import common

BLANK = "▁"
BLOCK_BYTES = 32 << 20
PACK_BYTES = 1 << 18
GROUP = 1 << 20
LONG = 256
# Pairs of characters below this, and of the blank, are looked up in a table.
NEAR = 0x800
UNKNOWN_PENALTY = 10.0
RULES = ("scores", "model")
_WORD = re.compile(f"{BLANK}+[^{BLANK}]*")


@dataclass
class Model:
    """The pieces of a model file: text to id and score, ids to bytes, and what can stand together."""

    ids: dict[str, int]
    scores: dict[str, float]
    raw: list[bytes]
    byte_id: int
    unknown: float
    width: int
    joined: frozenset[str]
    merges: bool

    def __post_init__(self):
        side = NEAR + 2  # codes: the characters below NEAR, the blank, any other
        code = lambda c: NEAR if c == BLANK else min(ord(c), NEAR + 1)
        self.near = np.zeros(side * side, bool)
        self.near[[code(a) * side + code(b) for a, b in self.joined if code(a) <= NEAR >= code(b)]] = True
        self.far = np.array(sorted(ord(a) << 21 | ord(b) for a, b in self.joined if max(code(a), code(b)) > NEAR), np.int64)
        self.spellings = pa.array(self.raw, pa.binary())

    @classmethod
    def read(cls, path: str) -> Model:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto.FromString(m.serialized_model_proto())
        kind, piece_kinds = proto.trainer_spec.model_type, pb.ModelProto.SentencePiece
        if kind not in (pb.TrainerSpec.BPE, pb.TrainerSpec.UNIGRAM) or {p.type for p in proto.pieces} & {piece_kinds.USER_DEFINED, piece_kinds.UNUSED}:
            raise ValueError(f"{path}: only BPE and unigram models without user-defined and unused pieces")
        n = m.get_piece_size()
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        ids = {m.id_to_piece(i): i for i in plain}
        scores = {p: m.get_score(i) for p, i in ids.items()}
        raw = []
        for i in range(n):
            piece = m.id_to_piece(i)
            raw.append(bytes([int(piece[3:5], 16)]) if m.is_byte(i) else piece.replace(BLANK, " ").encode() if piece in ids else b"")
        joined = frozenset(p[k : k + 2] for p in ids for k in range(len(p) - 1))
        if any(b == BLANK != a for a, b in joined):
            raise ValueError(f"{path}: pieces across the start of a word")
        return cls(ids, scores, raw, m.piece_to_id("<0x00>"), min(scores.values()) - UNKNOWN_PENALTY, max(map(len, ids)), joined, kind == pb.TrainerSpec.BPE)

    def units(self, word: str) -> list[str]:
        """``word`` cut where no piece can cross."""
        out, start = [], 0
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in self.joined:
                out.append(word[start:k])
                start = k
        return [*out, word[start:]]

    def cut(self, texts: list[str]) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
        """The units of the blank-escaped texts, their lengths, and for each text and the end the number of units before."""
        escaped = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
        begins = np.cumsum([0, *map(len, escaped)])
        whole = "".join(escaped)
        if not whole:
            return pa.array([], pa.string()), np.zeros(0, np.int64), begins
        data, chars = whole.encode(), np.frombuffer(whole.encode("utf-32-le"), "<u4")
        codes = np.minimum(chars, NEAR + 1).astype(np.int32)
        codes[chars == ord(BLANK)] = NEAR
        first = np.ones(len(chars), bool)
        np.logical_not(self.near[codes[:-1] * (NEAR + 2) + codes[1:]], out=first[1:])
        other = np.flatnonzero((codes[:-1] > NEAR) | (codes[1:] > NEAR))
        first[other + 1] = ~np.isin(chars[other].astype(np.int64) << 21 | chars[other + 1], self.far)
        first[begins[:-1][np.diff(begins) > 0]] = True
        at = np.flatnonzero(first)
        sizes = 1 + (chars >= 0x80).astype(np.int8) + (chars >= 0x800) + (chars >= 0x10000)
        offsets = np.append((np.cumsum(sizes, dtype=np.int32) - sizes)[at], len(data)).astype(np.int32)
        units = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))
        return units, np.diff(at, append=len(chars)), np.searchsorted(at, begins)

    def fold(self, unit: str) -> list[int]:
        """The best path of one unit, by the rule of ``lattice``; unknown characters as -1 - code."""
        n = len(unit)
        best, back = [0.0] * (n + 1), [(0, 0)] * (n + 1)
        for end in range(1, n + 1):
            top = None
            for start in range(max(0, end - self.width), end):
                piece = unit[start:end]
                known = self.ids.get(piece)
                if known is None and end - start > 1:
                    continue
                score = best[start] + (self.scores[piece] if known is not None else self.unknown)
                if top is None or score > top:
                    top, back[end] = score, (start, known if known is not None else -1 - ord(piece))
            best[end] = top
        path, at = [], n
        while at:
            path.append(back[at][1])
            at = back[at][0]
        return path[::-1]

    def merged(self, unit: str) -> list[int]:
        """One unit's characters merged in the order of the scores; unknown characters as -1 - code."""
        n, scores = len(unit), self.scores
        # By start of a symbol: its end, 0 once it is part of another, and the start of the one before.
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = [(-scores[unit[a : a + 2]], a, a + 1, a + 2) for a in range(n - 1) if unit[a : a + 2] in scores]
        heapify(pairs)
        while pairs:
            _, a, b, end = heappop(pairs)
            if ends[a] != b or ends[b] != end:
                continue
            ends[a], ends[b] = end, 0
            if end < n:
                before[end] = a
                score = scores.get(unit[a : ends[end]])
                if score is not None:
                    heappush(pairs, (-score, a, end, ends[end]))
            if a:
                score = scores.get(unit[before[a] : end])
                if score is not None:
                    heappush(pairs, (-score, before[a], a, end))
        path, at = [], 0
        while at < n:
            known = self.ids.get(unit[at : ends[at]])
            path.append(known if known is not None else -1 - ord(unit[at]))
            at = ends[at]
        return path

    def path(self, unit: str, rule: str) -> list[int]:
        return self.merged(unit) if rule == "model" and self.merges else self.fold(unit)

    def spelled(self, ids: list[int]) -> bytes:
        """Ids as 32-bit little-endian numbers, unknown characters as the ids of their bytes."""
        flat = []
        for i in ids:
            flat += [i] if i >= 0 else [self.byte_id + b for b in chr(-1 - i).encode("utf-8", "surrogatepass")]
        return np.array(flat, "<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        """The text of ids as ``encode`` gives them."""
        got = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return got[1:] if got.startswith(" ") else got


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model.read(path)
    return _models[path]


def escaped(text: str) -> list[str]:
    """The blank-escaped words of a text, each with all blanks before it; joined, they are the whole escaped text."""
    if "  " in text or text[:1] == " " or BLANK in text:
        return _WORD.findall(BLANK + text.replace(" ", BLANK))
    return [BLANK + w for w in text.split(" ")] if text else []


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """piece, id, score: as many rows as the model has pieces."""
    m = model(path)
    rows = pa.table({"piece": list(m.ids), "id": pa.array(m.ids.values(), pa.int32()), "score": pa.array([m.scores[p] for p in m.ids], pa.float64())})
    return spark.createDataFrame(rows)


def lattice(units: DataFrame, table: DataFrame, width: int, unknown: float, *keep: str) -> DataFrame:
    """unit (distinct) -> ``keep`` and ids, the best path; unknown characters as -1 - code."""
    n = F.char_length("unit")
    spans = units.select("unit", *keep, F.explode(F.sequence(F.lit(1), n)).alias("end"))
    spans = spans.select("unit", *keep, "end", F.explode(F.sequence(F.greatest(F.col("end") - width, F.lit(0)), F.col("end") - 1)).alias("start"))
    spans = spans.withColumn("piece", F.expr("substring(unit, start + 1, end - start)"))
    # The piece table has the model's size, whatever the data.
    edges = spans.join(F.broadcast(table), "piece", "left").where("id IS NOT NULL OR end - start = 1")
    edge = F.struct("end", "start", F.coalesce("id", -1 - F.ascii("piece")).alias("id"), F.coalesce("score", F.lit(unknown)).alias("score"))
    grouped = edges.groupBy("unit").agg(F.array_sort(F.collect_list(edge)).alias("_edges"), *(F.first(k).alias(k) for k in keep))
    folded = F.expr("""aggregate(_edges, named_struct('best', array(0D), 'back', cast(array() as array<struct<start:int,id:int>>)),
        (a, e) -> CASE WHEN size(a.best) = e.end
            THEN named_struct('best', array_append(a.best, a.best[e.start] + e.score), 'back', array_append(a.back, named_struct('start', e.start, 'id', e.id)))
          WHEN a.best[e.start] + e.score > a.best[e.end]
            THEN named_struct('best', array_append(slice(a.best, 1, e.end), a.best[e.start] + e.score), 'back', array_append(slice(a.back, 1, e.end - 1), named_struct('start', e.start, 'id', e.id)))
          ELSE a END, a -> a.back)""")
    walked = F.expr("""aggregate(sequence(1, size(_back)), named_struct('at', size(_back), 'ids', cast(array() as array<int>)),
        (a, k) -> CASE WHEN a.at = 0 THEN a ELSE named_struct('at', _back[a.at - 1].start, 'ids', array_append(a.ids, _back[a.at - 1].id)) END, a -> reverse(a.ids))""")
    return grouped.select("unit", *keep, F.explode(F.array(folded)).alias("_back")).select("unit", *keep, walked.alias("ids"))


def _packed(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        turn = TaskContext.get().partitionId()
        rows, size = [], 0

        def pack() -> pa.RecordBatch:
            return pa.record_batch([pa.array([turn % blocks], pa.int32()), pa.array([press.compress(pickle.dumps(rows))], pa.binary())], names=["block", "pack"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows.append((doc_id, text or ""))
                size += len(rows[-1][1])
                if size >= PACK_BYTES:
                    yield pack()
                    rows, size, turn = [], 0, turn + 1
        if rows:
            yield pack()

    return run


def _unpacked(blob: pa.Scalar) -> list[tuple]:
    return pickle.loads(zstandard.decompress(blob.as_py()))


def _grouped(blobs: Iterable[pa.Scalar]) -> Iterator[list[tuple]]:
    """The rows of packs, those of about ``GROUP`` characters together."""
    rows, size = [], 0
    for blob in blobs:
        rows += (more := _unpacked(blob))
        size += sum(len(text) for _, text in more)
        if size >= GROUP:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def _wanted(path: str):
    """The distinct units of each block; the packs come sorted by block, so one block is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        packs = ((block, blob) for batch in batches for block, blob in zip(batch.column("block").to_pylist(), batch.column("pack"), strict=True))
        for block, mine in groupby(packs, itemgetter(0)):
            found, more, count = pa.array([], pa.string()), [], 0
            for rows in _grouped(blob for _, blob in mine):
                units, lengths, _ = m.cut([text for _, text in rows])
                more.append(pc.unique(units.filter(pa.array(lengths <= LONG))))
                count += len(more[-1])
                if count > len(found):
                    found, more, count = pc.unique(pa.chunked_array([found, *more])), [], 0
            found = pc.unique(pa.chunked_array([found, *more]))
            for at in range(0, len(found), 20_000):
                part = found[at : at + 20_000]
                yield pa.record_batch([pa.array(np.full(len(part), block, np.int32)), part], names=["block", "unit"])

    return run


def _merged(path: str):
    """The distinct units, each merged once; the ids as ``spelled`` gives them."""
    schema = pa.schema([("unit", pa.string()), ("blocks", pa.list_(pa.int32())), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            ids = pa.array([m.spelled(m.merged(u)) for u in batch.column("unit").to_pylist()], pa.binary())
            yield pa.record_batch([batch.column("unit"), batch.column("blocks").cast(schema.field("blocks").type), ids], schema=schema)

    return run


def _joined(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _flat(found: pa.BinaryArray, marks: np.ndarray) -> tuple[pa.Buffer, np.ndarray]:
    """The bytes of all values in a row, and where in them the values at ``marks`` begin."""
    if not len(found):
        return pa.py_buffer(b""), np.zeros(len(marks), np.int32)
    offsets = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1]
    return found.buffers()[2][int(offsets[0]) : int(offsets[-1])], (offsets - offsets[0])[marks].astype(np.int32)


def _assembled(path: str, rule: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("restored", pa.bool_())])

    def run(packs: pa.Table, known: pa.Table) -> pa.Table:
        m = model(path)
        names, ids = _joined(known.column("unit")), known.column("ids")
        if not pa.types.is_binary(ids.type):
            ids = pa.chunked_array([pa.array(map(m.spelled, part.to_pylist()), pa.binary()) for part in ids.chunks], pa.binary())
        ids = _joined(ids)
        parts = []
        for rows in _grouped(packs.column("pack")):
            texts = [text for _, text in rows]
            units, _, before = m.cut(texts)
            place, spelled = pc.index_in(units, value_set=names), ids
            if place.null_count:
                rest = place.is_null()
                long = pc.unique(units.filter(rest))
                if pc.min(pc.utf8_length(long)).as_py() <= LONG:
                    raise KeyError("a unit that nobody asked for")
                place = pc.replace_with_mask(place, rest, pc.add(pc.index_in(units.filter(rest), value_set=long), pa.scalar(len(names), pa.int32())))
                spelled = pa.concat_arrays([ids, pa.array([m.spelled(m.path(u, rule)) for u in long.to_pylist()], pa.binary())])
            data, ends = _flat(spelled.take(place), before)
            back, places = _flat(m.spellings.take(pa.array(np.frombuffer(data, "<u4"))), ends // 4)
            mine = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), data])
            same = [b" " + t.encode() == back[a:b].to_pybytes() or m.decode(data[c:d].to_pybytes()) == t for t, a, b, c, d in zip(texts, places.tolist(), places[1:].tolist(), ends.tolist(), ends[1:].tolist(), strict=False)]
            parts.append(pa.record_batch([pa.array([d for d, _ in rows], pa.int64()), pa.array(np.diff(ends).astype(np.int64) // 4), mine, pa.array(same)], schema=schema))
        return pa.Table.from_batches(parts, schema=schema)

    return run


def encode(docs: DataFrame, path: str, rule: str = "scores") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (binary, 32-bit little-endian), restored (decoding gives the text)."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(4, -(-total // BLOCK_BYTES))
    m = model(path)
    packs = rows.mapInArrow(_packed(blocks), "block int, pack binary").repartition(blocks, "block")
    # In the lattice every unit grows to dozens of edges behind this shuffle, so its partitions are kept small and many.
    asked = packs.sortWithinPartitions("block").mapInArrow(_wanted(path), "block int, unit string").repartition(16 * blocks, "unit").groupBy("unit").agg(F.collect_list("block").alias("blocks"))
    if rule == "model" and m.merges:
        best = asked.mapInArrow(_merged(path), "unit string, blocks array<int>, ids binary")
    else:
        best = lattice(asked, piece_table(spark, path), m.width, m.unknown, "blocks")
    known = best.select(F.explode("blocks").alias("block"), "unit", "ids")
    return packs.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_assembled(path, rule), "doc_id long, n_tokens long, ids binary, restored boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids -> doc_id, text, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array([m.decode(i or b"") for i in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op2_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    common.small_batches(spark)  # the caller runs the query, so these settings stay in the session
    got = encode(common.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), rule="model")
    return got.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "restored")
