import re

import duckdb
import pytest

from folioscope.llm import queries, urlfilter

URLS = [
    None, "", "no scheme", "http://", "://x.net/", "http://x.net", "http://x.net/", "http://NET/a", "http://xnet/a", "http://a.b.net?x=/en/", "https://example.net/en/1", "https://WWW.Example.NET/en/",
    "https://www.example.net/EN/1", "https://notexample.net/en/", "http://example.com/de/", "http://example.com/deu/", "http://x.org/fr/", "http://x.org/fr", "http://org/fr/#a", "http://x.org/en/?u=http://y.net/",
    "http://casino-win.example.org/en/1", "http://casinos.example.org", "http://mycasino.example.org/", "http://anti-spam.example.org/", "http://spam.example.org/", "http://a.example.org/adserver/x", "http://a.example.org/ADS/Click?x",
    "http://a.example.org/wp-login.phpx", "http://a.example.org/wp-login.php", "ftp://ads-b.example.org:80/\n?x", "http://xn--mnchen-3ya.de/été", "http://x.net\n/", "http://" + "a." * 20_000 + "net/" + "b/" * 20_000,
]


def fits(pattern, part, url):
    """One rule on one url, by its definition."""
    m = re.search(r"(?s)://([^/?#]*)([^?#]*)(.*)", url or "")
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    host, path, rest = (low(m[1]), m[2], m[2] + m[3]) if m else ("", "", "")
    text = {"place": host + path, "host": host, "url": host + low(rest)}[part]
    p = pattern if part == "place" else low(pattern)
    core = p[2:] if p.startswith("||") else p[1:] if p.startswith("|") else p
    core, end = (core[:-1], True) if core.endswith("|") else (core, False)
    boundary = lambda i: [i] * (i in (0, len(text))) + [i + 1] * (i < len(text) and not re.match("[A-Za-z0-9]", text[i]))
    begins = [0, *(i + 1 for i, c in enumerate(host) if c == ".")] if p.startswith("||") else [0] if p.startswith("|") else range(len(text) + 1)
    at = set(begins)
    for c in core:
        at = set(range(min(at), len(text) + 1)) if c == "*" and at else {j for i in at for j in (boundary(i) if c == "^" else [i + 1] * (text[i : i + 1] == c))}
    return bool(at) and (not end or len(text) in at)


def brute(url, rules):
    places = sorted((-len(r), r, v) for r, v, part, p in rules if part == "place" and fits(p, part, url))
    found = sorted((v, r) for r, v, part, p in rules if part != "place" and fits(p, part, url))
    return (places[0][1], places[0][2], None) if places else (None, *found[0]) if found else (None, "allow", None)


MORE = [("tie/", "allow", "place", "||ple.org/en/"), ("|x", "block", "host", "|x.org|"), ("*", "block", "url", "/f*r/"), ("x^", "block", "url", "^de^"), ("up", "block", "url", "||A.example.org/W*"), ("_", "allow", "host", "_(x)[y]{z}"), ("net/", "block", "place", "||net/")]


@pytest.mark.parametrize("in_row", [urlfilter.IN_ROW, 0])
def test_judged_equals_brute_force(spark, in_row):
    rules = [tuple(r) for r in urlfilter.default_rules(spark).collect()] + MORE
    odd = [(None, "block", "url", "x"), ("n", None, "url", "x"), ("n", "block", None, "x"), ("n", "block", "url", None), ("n", "block", "url", ""), ("n", "block", "what", "x"), ("n", "block", "url", "n" * 3000)]
    pages = spark.createDataFrame([(i, u, "old", 1) for i, u in enumerate([*URLS, URLS[-3]])], "page_id long, url string, host string, word int")
    got = urlfilter.judge(pages, spark.createDataFrame(rules + odd, urlfilter.RULE), in_row=in_row)
    assert got.columns == ["page_id", "url", "word", "host", "path", "rule", "verdict", "pattern"]
    found = {r.page_id: (r.rule, r.verdict, r.pattern) for r in got.collect()}
    assert found == {i: brute(u, rules) for i, u in enumerate([*URLS, URLS[-3]])}
    assert urlfilter.judge(pages.limit(0), spark.createDataFrame(rules, urlfilter.RULE), in_row=in_row).count() == 0
    bare = urlfilter.judge(pages, spark.createDataFrame([], urlfilter.RULE), in_row=in_row - 1)
    assert {(r.rule, r.verdict) for r in bare.collect()} == {(None, "allow")}


def test_rules_are_filed_under_their_rarest_word(spark):
    urls = spark.createDataFrame([("http://www.a.com/",), ("http://www.b.com/",), ("http://www.b.net/",)], "u string")
    rules = [("1", "block", "url", "||www.b.com^"), ("2", "block", "url", "www.a.co"), ("3", "block", "url", "b*com"), ("4", "block", "url", "||b.com|"), ("5", "block", "url", "^www.zzz.com^")]
    from pyspark.sql import functions as F

    got = {r.rule: r.word for r in urlfilter.index(spark.createDataFrame(rules, urlfilter.RULE), urls, F.col("u")).collect()}
    assert got == {"1": "b", "2": "a", "3": "", "4": "b", "5": "zzz"}


def test_sql_agrees(spark, sf):
    pages = spark.createDataFrame(list(enumerate(u for u in URLS if u is None or "\n" not in u)), "page_id long, url string")
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [tuple(r) for r in pages.collect()])
    got = urlfilter.judge(pages, urlfilter.default_rules(spark)).select("page_id", "host", "path", "rule", "verdict")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(urlfilter.SQL).fetchall())
    con.sql(f"CREATE OR REPLACE VIEW pages2 AS FROM '{sf}/pages.parquet'")
    want = sorted(con.sql(urlfilter.SQL.replace("FROM pages)", "FROM pages2)")).fetchall())
    assert sorted(map(tuple, queries.op13_url_filters(spark, sf).collect())) == want and {r[4] for r in want} == {"allow", "block"}
