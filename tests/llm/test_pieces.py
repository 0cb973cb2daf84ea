import pickle
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import zstandard
from sentencepiece import sentencepiece_model_pb2 as pb

from foliomill.llm import common, pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "   a  b ", "a\nb\tc\r\n", "Of edatha, thwhing to eron.", "é 中文 \U0001f600 ▁ x", "ß\x00\x01", "x" * 700 + " y", "word " * 4000, "Naïve — “quotes”… don't", "١٢٣ Привет мир", "a b", "=" * 300]


@pytest.fixture(scope="module")
def unigram():
    """The library's own Viterbi over the same pieces and scores."""
    proto = pb.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def test_equals_the_library_and_round_trips(spark, unigram):
    rows = [(i if i % 5 else None, t, "x") for i, t in enumerate(ODD)] + [(5, ODD[5], "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = pieces.encode(docs, PATH).collect()
    assert len(got) == len(rows) and all(r.n_tokens * 4 == len(r.ids) for r in got)
    want = {}
    m = pieces.model(PATH)
    for _, t, _ in rows:
        ids = [i for w in pieces.escaped(t or "") for u in m.units(w) for i in m.fold(u)]
        want.setdefault(np.frombuffer(m.spelled(ids), "<u4").tobytes(), []).append(t)
    assert sorted(r.ids for r in got) == sorted(k for k, v in want.items() for _ in v)
    for r in got:
        assert r.restored == (BLANKS not in (want[r.ids][0] or ""))
    back = sorted(r.text for r in pieces.decode(pieces.encode(docs, PATH), PATH).collect())
    assert back == sorted((t or "").replace(BLANKS, " ") for _, t, _ in rows)
    assert pieces.encode(docs.limit(0), PATH).collect() == []


BLANKS = "▁"


def test_folds_equal_the_library(spark, unigram):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    words = sorted({w for t in docs for w in (t or "").split()})[:1500]
    m = pieces.model(PATH)
    for word in [*words, "Ñandú", "日本語", "foo_bar", "aaaaaaaaaa"]:
        ids = [i for u in m.units(pieces.BLANK + word) for i in m.fold(u)]
        assert np.frombuffer(m.spelled(ids), "<u4").tolist() == unigram.encode(word), word


def test_lattice_equals_the_fold(spark):
    m = pieces.model(PATH)
    units = ["▁the", "ation", "é", "▁\U0001f600", "abcabc", "x" * 40, "▁▁▁", "ж", "日本"]
    got = pieces.lattice(spark.createDataFrame([(u,) for u in units], "unit string"), pieces.piece_table(spark, PATH), m.width, m.unknown).collect()
    assert {r.unit: r.ids for r in got} == {u: m.fold(u) for u in units}


def test_the_models_own_ids(spark):
    """Against the file as given, a BPE model, whole texts."""
    own = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [*ODD, "tiering", "  two  blanks   and four     end  ", "▁▁a ▁ b▁", " " * 700 + "x" + " " * 40, "中" * 300 + "é" * 300]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    encoded = pieces.encode(docs, PATH, rule="model")
    got = {r.doc_id: r for r in encoded.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == own.encode(t or ""), t
        assert got[i].restored == (BLANKS not in (t or ""))
    assert {r.doc_id: r.text for r in pieces.decode(encoded, PATH).collect()} == {i: (t or "").replace(BLANKS, " ") for i, t in enumerate(texts)}


def test_the_query_gives_the_models_own_ids(spark):
    own = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {(r.doc_id, r.n_tokens) for r in pieces.op2_pieces(spark, "/root/testdata/sf0.001").collect()}
    assert got == {(r.doc_id, len(own.encode(r.text or ""))) for r in docs}


def test_cuts_as_the_words_do():
    m = pieces.model(PATH)
    texts = [*(t or "" for t in ODD), "▁▁a ▁ b▁", "߿ࠀ￿ \x7f\x80", "中" * 300 + "é" * 300, "x" * 700 + "▁y\nz"]
    units, lengths, before = m.cut(texts)
    units = units.to_pylist()
    assert [len(u) for u in units] == lengths.tolist()
    for i, text in enumerate(texts):
        assert units[before[i] : before[i + 1]] == [u for w in pieces.escaped(text) for u in m.units(w)], text
    assert m.cut(["", ""])[2].tolist() == [0, 0, 0]


def test_a_block_of_many_units_is_held_as_arrays(monkeypatch):
    """Peak of what Python allocates in the tasks for one block with some 100,000 distinct units, cut in small groups."""
    monkeypatch.setattr(pieces, "GROUP", 1 << 16, raising=False)
    draw, m = random.Random(1).choices, pieces.model(PATH)
    texts = [" ".join("".join(draw("etaoinshr", k=9)) for _ in range(1000)) for _ in range(100)]
    packs = [zstandard.ZstdCompressor().compress(pickle.dumps([(i, t)])) for i, t in enumerate(texts)]
    packed = pa.record_batch([pa.array([0] * len(packs), pa.int32()), pa.array(packs, pa.binary())], names=["block", "pack"])

    def peak(f):
        tracemalloc.start()
        try:
            return f(), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    asked, wanted = peak(lambda: pa.Table.from_batches(pieces._wanted(PATH)(iter([packed]))))
    units = asked.column("unit").to_pylist()
    assert len(units) == len(set(units)) > 95_000
    known = pa.table({"unit": units, "ids": pa.array([m.spelled(m.merged(u)) for u in units], pa.binary())})
    got, assembled = peak(lambda: pieces._assembled(PATH, "model")(pa.table({"pack": packed.column("pack")}), known))
    assert got.column("doc_id").to_pylist() == list(range(len(texts))) and all(got.column("restored").to_pylist())
    assert [m.decode(i) for i in got.column("ids").to_pylist()] == texts
    assert max(wanted, assembled) < 8 << 20, (wanted >> 10, assembled >> 10)


def test_the_query_holds_few_texts_at_once(spark):
    before = {name: spark.conf.get(name) for name in common.SMALL_BATCHES}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "4096")
        pieces.op2_pieces(spark, "/root/testdata/sf0.001")
        for name, most in common.SMALL_BATCHES.items():
            assert int(spark.conf.get(name)) <= most
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
