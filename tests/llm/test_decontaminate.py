import hashlib
import random
import re

from foliomill.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, bench):
    w, hit, items = words(text), set(), set()
    for item, body in bench:
        b = words(body)
        n = min(len(b), 13)
        wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b and item is not None else ()
        at = [s for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in wins] if n else []
        if wins and at:
            items.add(str(item))
            hit.update(k for s in at for k in range(s, s + n))
    ids = ",".join(sorted(items))
    return (len(w), len(hit), len(items), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))


def made(seed=4):
    rng = random.Random(seed)
    vocabulary = ["the"] * 6 + ["of", "a"] * 3 + [f"w{i}" for i in range(60)] + ["é", "Ünï", "x1"]
    bench = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 13, 14, 30])))) for i in range(20)]
    bench += [(3, bench[5][1]), (90, bench[5][1]), (None, "the of"), (91, None), (92, " ,. "), (93, "the the the"), (94, "never seen before")]
    docs = []
    for i in range(120):
        w = rng.choices(vocabulary, k=rng.randrange(80))
        for _ in range(rng.randrange(3)):
            b = words(rng.choice(bench)[1])
            cut = rng.randrange(max(1, len(b) - 14) + 1)
            at = rng.randrange(len(w) + 1)
            w[at:at] = b[cut : cut + rng.choice([12, 13, 20, 40])]
        docs.append((i if i % 9 else None, rng.choice([" ", ", ", "\n"]).join(w).upper() if i % 4 == 0 else " ".join(w), "en"))
    docs += [(500, None, "x"), (501, "", "x"), (502, " .. ", "x"), (7, docs[3][1], "x"), docs[8], docs[8], (503, (bench[2][1] + " ") * 40 + "the " * 3000, "x")]
    return docs, bench


def test_equals_brute_force(spark):
    docs, bench = made()
    d = spark.createDataFrame(docs, "doc_id long, text string, n_hit string").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted(repr(tuple(r)[:6]) for r in decontaminate.judge(d, b).collect())
    assert got == sorted(repr((i, *plain(t, bench))) for i, t, _ in docs)
    kept = decontaminate.clean_rows(d, b)
    assert kept.columns == d.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(repr(r) for r in docs if not plain(r[1], bench)[4])
    empty = decontaminate.judge(d, b.limit(0)).collect()
    assert len(empty) == len(docs) and not any(r.contaminated or r.n_near for r in empty)
    assert decontaminate.judge(d.limit(0), b).collect() == []


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    near = item.replace("zeta", "zeta strange word")
    docs = spark.createDataFrame([(1, "so " + near), (2, item), (3, "alpha " + "x " * 50 + "beta gamma"), (4, item.replace("beta", "zz"))], "doc_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_near) for r in decontaminate.judge(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert got[1] == (0, 1) and got[2] == (1, 1) and got[3] == (0, 0)


def test_sql_gives_the_same(spark):
    import duckdb
    from conftest import SMALL

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    assert sorted(con.execute(decontaminate.OP10_SQL).fetchall()) == sorted(map(tuple, decontaminate.op10_decontaminate(spark, SMALL).collect()))
