from clausemill.llm import url_filter as U
from clausemill.llm.common import table


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = max(((len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best and best[3], best[2] if best else default


RULES = [*U.RULES, ("www.example.org", "/en/12/", "allow"), ("org", "/en/", "block"), ("org", "/en/", "allow"), ("a.b", "/cc", "block"), ("b", "/ccdd", "allow"), ("xorg", "/", "block")]
URLS = [
    None, "", "no scheme/x", "http://", "http://org", "http://org/", "HTTP://Www.Example.ORG/en/12/3?q#f", "x://www.example.org/en/12",
    "http://a.example.org/es/1", "http://a.example.org/es", "http://xexample.org/es/1", "http://example.org?x=/es/", "http://org.com/de/", "http://com/fr/x://y/",
    "http://q.a.b/ccdd", "http://.org/x", "http://a..org/x", "http://org./x", "http://ex.com/DE/", "http://é.com/de/é\nz", "http://u:p@h.com:80/de/",
]


def test_edge_cases(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS * 3)] + [(None, "http://a.com/de/", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    got = sorted(((r.page_id is None, r.page_id), r.host, r.path, r.rule, r.verdict) for r in U.url_filter(pages, rules).collect())
    assert got == sorted(((i is None, i), *brute(u, RULES)) for i, u, _ in rows)


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/de/")], "page_id long, url string")
    rules = spark.createDataFrame(U.RULES, "host string, path string, verdict string")
    assert U.url_filter(pages.limit(0), rules).count() == 0
    assert U.url_filter(pages, rules.limit(0), "block").first().verdict == "block"


def test_whole_table(spark):
    pages = table(spark, "/root/testdata/sf0.1", "pages")
    rules = spark.createDataFrame(U.RULES, "host string, path string, verdict string")
    got = sorted(tuple(r) for r in U.url_filter(pages, rules).collect())
    assert got == sorted((r.page_id, *brute(r.url, U.RULES)) for r in pages.select("page_id", "url").collect())
    assert {r[4] for r in got} == {"allow", "block"}
