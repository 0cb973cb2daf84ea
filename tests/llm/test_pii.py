import re

from foliomill.llm import pii

TEXTS = [
    None, "", "nothing here", "mail is.35@mail4.example.com, or IS.35@MAIL4.EXAMPLE.COM.", "call +1 (017) 555-7713 or +1 017 555 7713!", "card 4756555320544449; 4756 5553 2054 4449",
    "ssn 123-45-6789 ip 192.168.1.7 iban DE89 3704 0044 0532 0130 00 end", "Mr. John Smith met Mrs Smith and Frau Anna Müller; Г-н Иван Петров", "x" * 3000 + "@" + "1234567890 " * 2000,
    "id 04dbebab91ab85687d33eeaaf9ac699e1188f962 is no card; 12 34 and 2024-01-02 neither", "a@b a@b.c é.x@y.org +12", "is.35@mail4.example.com " * 50,
]


def run(spark, rows, key="k"):
    docs = spark.createDataFrame(rows, "doc_id long, text string, kinds string").repartition(3)
    return docs, pii.replace(docs, key).collect()


def test_types_coreference_and_distinctness(spark):
    rows = [(i, t, "q") for i, t in enumerate(TEXTS)]
    _, got = run(spark, rows)
    new = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert new[0].text is None and new[1].text == "" and new[2].text == TEXTS[2] and new[9].text == TEXTS[9] and new[2].n_entities == 0
    a, b = re.findall(r"[\w.]+@[\w.]+\w", new[3].text)
    assert a != "is.35@mail4.example.com" and b == a.upper() and a in new[11].text and new[11].text.count(a) == 50
    p, q = re.fullmatch(r"call (\+\d \(\d{3}\) \d{3}-\d{4}) or (\+\d \d{3} \d{3} \d{4})!", new[4].text).groups()
    assert re.sub(r"\D", "", p) == re.sub(r"\D", "", q) != "10175557713"
    c, d = re.fullmatch(r"card (\d{16}); (\d{4} \d{4} \d{4} \d{4})", new[5].text).groups()
    assert d.replace(" ", "") == c != "4756555320544449"
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4} ip 10\.\d+\.\d+\.\d+ iban DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d end", new[6].text)
    m = re.fullmatch(r"Mr. (\w+n) (\w+) met Mrs (\w+) and Frau (\w+na) (\w+); Г-н ([а-яА-Я]+) ([а-яА-Я]+)", new[7].text)
    assert m and m[2] == m[3] != m[5] and "Smith" not in new[7].text
    assert new[8].text == TEXTS[8] and "@y.org" not in new[10].text
    assert {r.doc_id: r.text for r in run(spark, rows)[1]} == {r.doc_id: r.text for r in got}
    assert {r.doc_id: r.text for r in run(spark, rows, "other")[1]}[5] != new[5].text


def test_contested_draws_are_settled(spark, monkeypatch):
    # Only ten surrogates to draw from at first: everybody collides, and 1 .. 9 are real.
    values = [f"{i}00-00-0000" for i in range(1, 8)]
    monkeypatch.setattr(pii, "_digits", lambda: pii.F.concat(pii.F.substring("digest", 1, 1).cast("binary").cast("string"), pii.F.lit("00000000")))
    entities = spark.createDataFrame([("ssn", re.sub("-", "", v)) for v in values], "type string, entity string")
    got = pii.surrogates(entities, "k").collect()
    assert len(got) == 7 and len({r.plain for r in got}) == 7 and not {r.plain for r in got} & {r.entity for r in got}


def test_rows_keep_their_columns(spark):
    rows = [(None, TEXTS[3], "a"), (1, TEXTS[3], "b"), (1, TEXTS[3], "b"), (1, TEXTS[5], "c"), (2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _mix string")
    got = pii.replace_rows(docs, "k")
    assert got.columns == docs.columns and got.count() == 5
    assert sorted(str(r[2]) for r in got.collect()) == ["None", "a", "b", "b", "c"]
    assert not any("is.35" in (r.text or "") or "4756555320544449" in (r.text or "") for r in got.collect())
    assert pii.replace_rows(docs.limit(0), "k").collect() == []


def test_given_documents_hold_nothing_found_before(spark):
    from conftest import SMALL

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r.mention for r in pii.mentions(docs).collect()}
    text = "\n".join(r.text or "" for r in pii.replace(docs, "k").collect())
    assert before and not any(m in text for m in before)


def test_more_numbers_than_free_values_are_settled(spark):
    # 70 real numbers of two digits leave 30 free ones; the others grow.
    entities = spark.createDataFrame([("phone", f"{i:02}") for i in range(70)], "type string, entity string")
    got = pii.surrogates(entities, "k").collect()
    assert len(got) == 70 == len({r.plain for r in got}) and not {r.plain for r in got} & {r.entity for r in got}
    assert sum(len(r.plain) == 2 for r in got) <= 30 and all(re.fullmatch("[0-9]{2,}", r.plain) for r in got)


def test_lengthened_numbers_reach_the_text(spark, monkeypatch):
    monkeypatch.setattr(pii, "LENGTHEN", 0)
    _, got = run(spark, [(1, "call +1 (017) 555-7713, ssn 123-45-6789, ip 192.168.1.7 and 192.168.1.7 end", "q")])
    m = re.fullmatch(r"call \+\d \(\d{3}\) \d{3}-\d{5}, ssn \d{3}-\d{2}-\d{5}, ip (\S+) and (\S+) end", got[0].text)
    assert m and m[1] == m[2] and all(256 <= int(x) <= 999 for x in m[1].split("."))


def test_a_phone_has_seven_digits(spark):
    text = "since +1990 or +1234 5 or 12 345 +67 890, but +12 345 67, +1-(017)-55 77 and +49 (30) 12 34 56"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert sorted(r.mention for r in pii.mentions(docs).collect()) == ["+1-(017)-55 77", "+12 345 67", "+49 (30) 12 34 56"]


def test_digits_are_drawn_evenly(spark):
    row = spark.range(3000).selectExpr("sha2(cast(id AS string), 256) AS digest").select(pii._digits().alias("d")).collect()
    text = "".join(r.d for r in row)
    assert len(text) == 3000 * 64 and all(abs(text.count(c) / len(text) - 0.1) < 0.005 for c in "0123456789")


def test_columns_of_the_names_used_inside(spark):
    docs = spark.createDataFrame([(1, "write to a.b@example.com", "n", "k", "w"), (2, None, None, None, None)], "doc_id long, text string, _n_ string, _Kinds_ string, _news_ string")
    rows = {r.doc_id: r for r in pii.replace_rows(docs, "k").collect()}
    assert "a.b@example.com" not in rows[1].text and tuple(rows[1])[2:] == ("n", "k", "w") and rows[2].text is None
