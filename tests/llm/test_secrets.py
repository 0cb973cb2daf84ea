import base64
import random
import re

from foliomill.llm import secrets

ODD = [None, "", "token = 'abc'", "PASSWORD:abcdef token=\"x.y/z+1=\" api-key = 1234567", "Api_Key  =  abcdefg apikey:'0123456789abcdef0123456789abcdef'",
       "AKIA" + "A" * 16 + " AKIA123 AKIA" + "Z9" * 10 + "x", "ſecret=abcdefgh toKen=abcdefgh secret=abcdef", "é" * 30 + "0" * 24 + "g" + "f" * 23, "deadbeef" * 4000]


def plain(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer("""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def test_base_spans_equal_the_plain_form(spark):
    rows = [(i if i % 3 else None, t, "x") for i, t in enumerate(ODD * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = secrets.scan(docs).collect()
    want = [(i, *(sum(k == j for _, k, _ in plain(t)) for j in range(3)), secrets.digest(plain(t))) for i, t, _ in rows]
    assert sorted(map(repr, ((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got))) == sorted(map(repr, want))
    for r in got:
        base = [f for f in r.found if f.kind < 3]
        assert secrets.digest([(f.start, f.kind, f.end) for f in base]) == r.base_sha256
    assert secrets.scan(docs.limit(0)).collect() == []


def test_random_runs_are_found_and_words_are_not(spark):
    rng = random.Random(1)
    key = lambda n: base64.b64encode(rng.randbytes(n)).decode().rstrip("=")
    planted = [(i, f"uses {key(30)} here") for i in range(60)]
    words = [(1000 + i, "the " + "".join(rng.choice(["the", "ing", "tion", "and", "ea", "st"]) for _ in range(9)) + " end " + "a" * 40 + " " + "0123456789abcdefghij" * 2) for i in range(400)]
    got = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(planted + words, "doc_id long, text string")).collect()}
    assert sum("random:5:45" in got[i] for i, _ in planted) >= 55
    assert sum("random" in got[i] for i, _ in words) <= 2


def test_thresholds_follow_the_step_up_rule():
    assert secrets.thresholds({}) == [secrets.BINS] * 4
    counts = {(1, 0): 90, (1, 100): 10}
    assert secrets.thresholds(counts)[1] <= 100
    assert secrets.thresholds({(1, 0): 1000})[1] == secrets.BINS


def test_keys_glued_to_names_urls_prefixes_and_base_spans_are_found(spark):
    rng = random.Random(2)
    plain64 = lambda: base64.b64encode(rng.randbytes(36)).decode()
    url64 = lambda: base64.urlsafe_b64encode(rng.randbytes(36)).decode()
    padded = lambda: base64.b64encode(rng.randbytes(34)).decode()
    forms = [("AWS_SECRET_ACCESS_KEY=", plain64, ""), ("https://files.example/d/report?sig=", url64, "&v=2"), ("AZURE_STORAGE_KEY=", padded, " next"), ("svc-prod_", lambda: "+/" + plain64(), ""),
             ("data/in/", lambda: "-_" + url64(), ""), ("", plain64, "=password=abcdef")]
    rows, want = [], {}
    for kind, (before, key, after) in enumerate(forms):
        for _ in range(40):
            k = key()
            want[len(rows)] = (kind, 4 + len(before), 4 + len(before) + len(k))
            rows.append((len(rows), f"see {before}{k}{after}"))
    words = [(1000 + i, "see " + "_".join(rng.choice(["the", "config", "main", "path", "value"]) for _ in range(7)) + "=" + "/".join(rng.choice(["usr", "share", "lib-x", "doc", "site_packages"]) for _ in range(7))) for i in range(400)]
    got = {r.doc_id: r.found for r in secrets.scan(spark.createDataFrame(rows + words, "doc_id long, text string")).collect()}
    hits = [0] * len(forms)
    for i, (kind, start, end) in want.items():
        hits[kind] += any(f.kind == 3 and f.start < end and f.end > start and min(f.end, end) - max(f.start, start) >= 20 for f in got[i])
    assert min(hits) >= 34, hits
    assert sum(any(f.kind == 3 for f in got[i]) for i, _ in words) <= 4
    for spans in got.values():
        assert all(a.end <= b.start for a, b in zip(spans, spans[1:]))


def test_parts_of_runs_outside_base_spans():
    text = "x" * 30 + "=password=abcdef " + "y" * 25
    assert secrets.base_spans(text) == [(31, 0, 46)]
    assert list(secrets.outside(text, [(31, 0, 46)])) == [(0, 31), (47, 72)]
    assert list(secrets.outside(text, [(0, 0, 50), (5, 2, 40), (60, 1, 65)])) == [(50, 60), (65, 72)]
