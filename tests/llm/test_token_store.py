import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from foliomill.llm import common, token_store

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "  ", "a  b   c", "a\n b \n\nc\t\td ", "don't we'll 'tis it''s", "thin, (of) end.", "x\x1cy \x1d z", "<|endoftext|> <|endoftext", "é ü ß中文 中 文 x  y　z\x85w", "Ab1c_d 12 3,4 ½ ²",
    "éa ́b thiń, thin​, ", "\U0001f600\U0001f600 a\U0001f600", "word " * 30_000, "x" * 20_000, "\r\n\r\n a \x0b \x0c",
]


def test_chunks_join_to_the_ids_of_whole_texts():
    rng = random.Random(2)
    alphabet = ["a", "B", " ", " ", "\n", "é", "1", ".", ",", "'", "s", "\t", " ", "　", "中", "́", "_", "|", "!"]
    texts = [t or "" for t in ODD] + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(6000)]
    tokenizer = Tokenizer.from_file(PATH)
    for text, got in zip(texts, token_store.encoder(PATH).encode(texts), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_elias_fano_select():
    rng = np.random.default_rng(1)
    for n, top in ((1, 0), (1, 9), (5, 3), (400, 100), (300, 10**6), (70, 2**32 - 1), (1000, 1000)):
        values = np.sort(rng.integers(0, top, n, endpoint=True))
        built = token_store.EliasFano.build(values)
        back = token_store.EliasFano(n, built.low_bits, built.lows, built.highs, built.samples.tobytes())
        assert back.values().tolist() == values.tolist()
        assert [back.select(k) for k in range(n)] == values.tolist()
    assert len(built.lows) + len(built.highs) < 8 * n


def test_store_round_trip(spark):
    rows = [(i * 3 - 9 if i % 6 else None, t, "x") for i, t in enumerate(ODD)] + [(7, "twice", "x"), (7, "twice", "x"), (7, "other", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)
    folder = common.scratch(spark, "t")
    token_store.write(docs, folder, PATH)
    got = token_store.checksums(token_store.read(spark, folder)).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted((i is not None, i or 0, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())) for i, t, _ in rows for ids in [tokenizer.encode(t or "", add_special_tokens=False).ids])
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    keys = [-99 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    empty = common.scratch(spark, "t")
    token_store.write(docs.limit(0), empty, PATH)
    assert token_store.checksums(token_store.read(spark, empty)).collect() == []
