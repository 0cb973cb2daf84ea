import re

from foliomill.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [
    None, "", " .,-!", "MIT License", "the mit-license, Apache\nLICENSE and CC-BY; cc by cc by 4.0", "cc0by ccby cc_by xcc by", "GNU GENERAL PUBLIC LICENSE version 3, mit  license",
    "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: MIT", "émit license mit licensé cc byé", "all rights reserved",
    "Released under the MIT License. " + "word " * 30_000 + "Apache License", "This work is licensed under the GNU General Public License, version 3.", "İ ﬀ MIT LICENSE \x01 \x02 mit\x01license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "creative commons attribution-sharealike 3.0 unported", "mit license " * 300,
]


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(text):
    """Every rule on every text, spans by counting words, containment by comparing all pairs."""
    w = words(text)
    norm = " " + " ".join(w) + " "
    found = []
    for r in licenses.rules():
        for m in re.finditer(f"(?<= )({r['regex']})(?= )", norm):
            found.append((norm[: m.start()].count(" ") - 1, norm[: m.end()].count(" "), r["priority"], r["label"]))
    base = [(s, lab) for s, _, p, lab in found if p == 0]
    kept = {lab for s, e, p, lab in found if p == 0 or not any(p2 > p and s2 <= s and e2 >= e for s2, e2, p2, _ in found)}
    return (len(w), len(base), min(base)[0] if base else None, max(base)[0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(kept)))


def test_equals_the_plain_form(spark):
    rows = [(i if i % 5 else None, t, "z") for i, t in enumerate(ODD * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = licenses.scan(docs).drop("detections").collect()
    want = [(i, *plain(t)) for i, t, _ in rows]
    assert sorted(map(repr, (tuple(r)[:-1] for r in got))) == sorted(map(repr, want))
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)
    assert licenses.scan(docs.limit(0)).collect() == []


def test_given_documents(spark):
    from conftest import SMALL

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    got = {r.doc_id: tuple(r)[1:-2] for r in licenses.scan(docs).collect()}
    assert got == {r.doc_id: plain(r.text) for r in docs.collect()}


def test_containment_prefers_the_more_specific(spark):
    docs = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0."), (2, "gpl license")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert got[1].base_labels == "apache" and got[1].labels == "apache,apache-2.0"


def test_rules_are_gated_soundly():
    gate = re.compile(licenses.VOCABULARY)
    samples = [t for t in ODD if t and len(t) < 2000]
    for r in licenses.rules():
        for t in samples:
            norm = " " + " ".join(words(t)) + " "
            if re.search(f"(?<= )({r['regex']})(?= )", norm):
                assert r["keyword"] in norm and gate.search(norm), (r, t)
