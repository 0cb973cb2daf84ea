import random
import re

from foliomill.llm import similar


def sets(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain(rows):
    """All pairs, then a walk over the links."""
    s = [sets(t) for _, t, *_ in rows]
    link = {i: [j for j in range(len(rows)) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j])] for i in range(len(rows))}
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(s[i]), min(ids) if ids else None))
    return out


def made(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.5:  # a copy, changed a little or more, of any earlier text
            w = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = " ".join(w).upper() if i % 10 == 0 else "\n".join(w)
        else:
            text = " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 4, 5, 6, 20, 60, 120])))
            if kind > 0.8:
                text = passage + " " + text
        rows.append((i * 7 % 1000 if i % 11 else None, text, "x"))
    return [*rows, (2000, None, "x"), (2001, "", "x"), (2002, " \n ", "x"), rows[3], rows[3], (3, rows[5][1], "y")]


def test_equals_all_pairs(spark):
    for seed in (1, 2):
        rows = made(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(5)
        got = similar.join(docs).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows)))


def test_no_link_is_lost_between_groups(spark, monkeypatch):
    """Without hub pairs the prefix join alone has to find all links."""
    rows = made(3)
    monkeypatch.setattr(similar, "_hub_pairs", lambda nodes: nodes.select(similar.F.col("node").alias("a"), similar.F.col("node").alias("b")).limit(0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = similar.join(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows)))


def test_one_per_group(spark):
    rows = [(5, "a b c d e f g h", 1), (3, "a b c d e f g h", 2), (3, "a b c d e f g h", 3), (9, "q r", 4), (None, "q r", 5), (7, None, 6), (8, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mix int")
    got = similar.one_per_group(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [3, 7, 8, 9]
    assert similar.one_per_group(docs.limit(0)).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901)], "a long, b long")
    got = {r.node: r.label for r in similar.components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}


def test_contracted(spark):
    """Groups join through links of any members; nodes without a group come in; the smallest node stays the label."""
    labels = spark.createDataFrame([(1, 1), (5, 1), (2, 2), (6, 2), (3, 3), (7, 3)], "node long, label long")
    links = spark.createDataFrame([(6, 5), (5, 2), (9, 6), (4, 8)], "a long, b long")
    got = similar.contracted(labels, links).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 1), (6, 1), (7, 3), (8, 4), (9, 1)]


def test_parity_never_says_more_than_the_sets_differ():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    for n in (1, 5, 30, 400, 5000):
        text = rng.choices(words, k=n)
        a, b = (similar.shingles(" ".join(rng.choice(words) if rng.random() < 0.02 else w for w in text)) for _ in range(2))
        differ = sum(int(x).bit_count() for x in similar.parity(a).view("u8") ^ similar.parity(b).view("u8"))
        assert differ <= len({*a.tolist()} ^ {*b.tolist()})
        assert not (similar.parity(a) ^ similar.parity(a)).any()


def test_a_family_is_not_joined_pair_by_pair(spark, monkeypatch):
    """Copies of one text with 0 to 9 changed words, linked or not: few rows for each document, and all links."""
    rng = random.Random(5)
    text, n = [f"t{i}" for i in range(150)], 160
    rows = []
    for i in range(n):
        w = list(text)
        for j in rng.sample(range(150), i % 10):
            w[j] = f"n{i}x{j}"
        rows.append((i * 13 % n, " ".join(w)))
    made, pairs, enough, verified = [], [], similar._enough, similar.verified
    monkeypatch.setattr(similar, "_enough", lambda found: made.append(found.count()) or enough(found))
    monkeypatch.setattr(similar, "verified", lambda docs, profiles, p: pairs.append(p.count()) or verified(docs, profiles, p))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = similar.join(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows))
    assert made[-1] <= 10 * n and pairs[-1] <= n


def test_tasks_hand_over_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows = spark.range(0, 2 * similar.BATCH + 1, 1, 1).mapInArrow(lambda batches: (b.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    assert max(r.n for r in similar._written(rows, "batches").collect()) <= similar.BATCH
    assert spark.conf.get(name) == before
