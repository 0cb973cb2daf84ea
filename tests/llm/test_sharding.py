import zlib
from collections import Counter

from foliomill.llm import sharding


def test_laws_on_odd_and_skewed_rows(spark):
    texts = [None, "", "é" * 9, "same", "x" * 100_000]
    rows = [(i if i % 7 else None, texts[i % 5], "hot" if i % 3 else (None if i % 2 else f"s{i % 4}"), 1) for i in range(1003)] + [(5, "same", "hot", 1)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int").repartition(7)
    got = sharding.assign(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert Counter((r.size, r.text_crc32) for r in got) == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    per = Counter(r.shard for r in got)
    assert set(per) == set(range(16)) and max(per.values()) - min(per.values()) <= 1
    for k in per:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(per[k]))
        for s, n in Counter(r[2] for r in rows).items():  # the mixture of the whole, up to rounding
            assert abs(sum(r.source == s for r in got if r.shard == k) - n * per[k] / len(rows)) <= 2
    again = sharding.assign(docs.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_fewer_rows_than_shards_and_none(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (2, "b", "s"), (3, None, None)], "doc_id long, text string, source string")
    assert sorted((r.shard, r.slot) for r in sharding.assign(docs).collect()) == [(0, 0), (1, 0), (2, 0)]
    assert sharding.assign(docs.limit(0)).collect() == []
