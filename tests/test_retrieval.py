import math
import random
import re
from collections import Counter

from conftest import SMALL
from pyspark.sql import functions as F

from foliomill.operators.retrieval import Corpus, search_in_documents


def bm25(texts, query):
    """Scores of a list of texts, worked out one by one."""
    words = [re.findall("[a-z0-9]+", t.lower()) for t in texts]
    asked = re.findall("[a-z0-9]+", query.lower())
    average = sum(map(len, words)) / len(words)
    out = []
    for mine in words:
        tf, score = Counter(mine), 0.0
        for term in asked:
            if tf[term]:
                df = sum(term in other for other in words)
                idf = math.log((len(words) - df + 0.5) / (df + 0.5) + 1)
                score += idf * tf[term] * 2.5 / (tf[term] + 1.5 * (0.25 + 0.75 * len(mine) / average))
        out.append(score)
    return out


def make_text(rng, n):
    return " ".join(rng.choice(["red", "blue", "disk", "fan", "a1", "Die", "für", "redder"]) for _ in range(n))


def test_corpus_equals_brute_force(spark):
    rng = random.Random(1)
    texts = [make_text(rng, rng.randint(0, 30)) for _ in range(60)]
    queries = {"one": "red", "two": "Red red, A1!", "none": "zzz", "blank": "..", "empty": ""}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    corpus = Corpus(docs, spark.createDataFrame(list(queries.items()), "query string, text string"))
    got = {(r["query"], r.doc_id): r.score for r in corpus.scores().collect()}
    want = {(q, i): s for q, text in queries.items() for i, s in enumerate(bm25(texts, text)) if s > 0}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {r.term: r.df for r in corpus.frequencies.collect()} == {t: sum(t in x.lower().split() for x in texts) for t in ("red", "a1", "zzz")}
    top = [(r["query"], r["rank"], r.doc_id) for r in corpus.top_k_or_first(3).collect()]
    for q in ("one", "two"):
        best = sorted(range(len(texts)), key=lambda i: (-want.get((q, i), 0), i))[:3]
        assert [d for name, _, d in sorted(top) if name == q] == best
    first = [i for i, t in enumerate(texts) if t][:3]
    assert [d for name, _, d in sorted(top) if name == "none"] == first
    assert [d for name, _, d in sorted(top) if name == "blank"] == first
    assert not [1 for name, _, _ in top if name == "empty"]


def test_inside_documents_equals_brute_force(spark):
    rng = random.Random(2)
    docs = [(i, "\n \n".join(make_text(rng, rng.randint(1, 12)) for _ in range(rng.randint(1, 9)))) for i in range(25)] + [(99, "")]
    rows = spark.createDataFrame(docs, "doc_id int, text string")
    for query in ("red fan", "fan fan a1", "nothing", "??"):
        got = {}
        for r in search_in_documents(rows, query, top_k=3).orderBy("doc_id", "rank").collect():
            got.setdefault(r.doc_id, []).append((r.paragraph, r.fallback))
        for i, text in docs:
            parts = [p.strip() for p in re.split(r"\n\s*\n", text.strip()) if p.strip()]
            scores = bm25(parts, query) if parts else []
            order = sorted((j for j, s in enumerate(scores) if s > 0), key=lambda j: (-round(scores[j], 9), j))[:3]
            want = [(parts[j], False) for j in order] or [(p, True) for p in parts[:3]]
            assert got.get(i, []) == want


def test_plan_of_the_corpus_search(spark):
    """The plan does not grow with the queries; ranks are limited before their shuffle."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    nodes = []
    for n in (1, 50):
        queries = spark.createDataFrame([(i, f"the und {i}") for i in range(n)], "item_id long, text string")
        search = Corpus(docs, queries, query="item_id").top_k_or_first(2)
        search.collect()
        plan = search._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        assert "WindowGroupLimit" in plan and final.count("FileScan parquet") <= 2
        nodes.append(plan.split("== Initial Plan ==")[1].count("+- "))
    assert nodes[0] == nodes[1]
    inside = search_in_documents(docs.withColumn("q", F.lit("a")), F.col("q"))
    assert "Exchange" not in inside._jdf.queryExecution().executedPlan().toString()


def test_every_query_of_a_table(spark):
    rng = random.Random(4)
    texts = [make_text(rng, rng.randint(0, 20)) for _ in range(50)] + [None]
    asked = [make_text(rng, rng.randint(0, 6)) for _ in range(120)] + [None, "fan zzz fan"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    queries = spark.createDataFrame([(f"q{i}", q, 1) for i, q in enumerate(asked)], "name string, asked string, doc_id int").repartition(3)
    corpus = Corpus(docs, queries, query="name", query_text="asked", first=3)
    got = {}
    for r in corpus.top_k_or_first(3).collect():
        got.setdefault(r.name, []).append((r["rank"], r.doc_id, r.fallback))
    plain = [t or "" for t in texts]
    for i, q in enumerate(asked):
        scores = bm25(plain, q or "")
        best = sorted((d for d, s in enumerate(scores) if s > 0), key=lambda d: (-scores[d], d))[:3]
        want = [(k, d, False) for k, d in enumerate(best, 1)] or [(k, d, True) for k, d in enumerate([d for d, t in enumerate(plain) if t][:3], 1) if q]
        assert sorted(got.get(f"q{i}", [])) == want, q
    assert Corpus(docs.limit(0), queries, query="name", query_text="asked").top_k_or_first(3).collect() == []
    assert Corpus(docs, queries.limit(0), query="name", query_text="asked").top_k_or_first(3).collect() == []


def test_a_blank_document_does_not_stop_the_others(spark):
    docs = spark.createDataFrame([(1, " \n\n "), (2, ""), (3, "contract term of the year")], "doc_id long, text string")
    assert {r.doc_id for r in search_in_documents(docs, "contract").collect()} == {3}
