import public_tokenizers

import corpus_pipeline
from conftest import SMALL

from foliomill.llm import common, pieces, pii


def test_stages_one_after_the_other(spark):
    """Each stage keeps the columns, drops what its operator drops, and the last gives back every text."""
    docs = common.documents(spark, SMALL)
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.staged(stage(spark, docs, SMALL), name.replace(" ", "-"))
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] >= seen[3] == seen[4] > 0
    assert docs.select("doc_id").distinct().count() == seen[4]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert not {r.mention for r in pii.mentions(common.documents(spark, SMALL)).collect() if r.kind == "email"} & {w.strip(".,;!") for t in texts.values() for w in t.split()}
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert {r.doc_id: r.text for r in pieces.decode(encoded, path).collect()} == texts


def test_stages_hold_few_texts_at_once(spark):
    """Behind each stage, a batch that goes to Python has few rows and bytes, and a smaller value of the session holds."""
    before = {name: spark.conf.get(name) for name in corpus_pipeline.SMALL_BATCHES}
    rows = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 2000) AS text")
    sizes = lambda: [r.n for r in rows.mapInArrow(lambda batches: (b.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()]
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "4096")
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "256m")
            assert max(sizes()) == 3000
            stage(spark, common.documents(spark, SMALL).limit(20), SMALL)
            got = sizes()
            assert sum(got) == 3000 and max(got) <= 500, name  # 10,000 bytes a text
            assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        corpus_pipeline.STAGES[0][1](spark, common.documents(spark, SMALL).limit(20), SMALL)
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
