from pathlib import Path

from foliomill.llm import urls

ODD = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/x", "http://www.example.com/en", "http://example.com", "http://example.com?x/en/",
       "http://a.example.com/en/a?b#c", "ftp://com/", "http://xcom/", "http://a.net/es/1#/fr/", "http://.net/es/", "x\n://É.net/fr/\nq", "a://b://c.com/", "http://" + "a." * 3000 + "net/es/" + "p/" * 3000, "http://cheap-pills.example.org/"]


def plain(url):
    import re

    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if c.isascii() else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    spam = re.search(rf"(^|[.-])({urls.SPAM_NAMES})([.-]|$)", host)
    return (host, path, *(max(fits)[1:] if fits else (None, "block" if spam else "allow")))


def test_odd_urls_equal_the_plain_form(spark):
    rows = [(i if i % 4 else None, u, "x", "y") for i, u in enumerate(ODD * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = urls.judge(pages, urls.rule_table(spark)).collect()
    want = [(i, *plain(u)) for i, u, *_ in rows]
    assert sorted(map(repr, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got))) == sorted(map(repr, want))
    assert urls.judge(pages.limit(0), urls.rule_table(spark)).collect() == []


def test_sql_gives_the_same(spark):
    import duckdb

    from conftest import SMALL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{Path(SMALL, 'pages.parquet')}'")
    want = con.execute(urls.OP5_SQL).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in urls.op5_urls(spark, SMALL).collect())
