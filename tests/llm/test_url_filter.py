import pytest

from pagequarry.llm import url_filter as U

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b.c", "/x", "block"), ("b.c", "/x/yz", "allow")]
URLS = [
    None,
    "",
    "no scheme",
    "http://EXAMPLE.Net/en/1",
    "https://m.example.net/EN/1",
    "ftp://example.network/",
    "http://net/",
    "http://net",
    "x://a.b.c/xyz?q#f",
    "x://b.c/x/yz",
    "x://z.a.b.c/x/yz",
    "http://org/fr/",
    "http://u:p@w.org:80/fr/",
    "http://example.com/de/?a=/fr/",
    "http://example.com#/de/",
    "http://" + "a." * 2000 + "net/",
    "a://b://net/",
    "http://example.com\n/de/",
]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("most_bits", [1 << 22, 1])
def test_against_brute_force(spark, monkeypatch, most_bits):
    monkeypatch.setattr(U, "MOST_BITS", most_bits)
    pages = spark.createDataFrame([(k, u, "kept") for k, u in enumerate(URLS + URLS[3:5])], "page_id long, url string, rule string")
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, RULES).collect()}
    for k, u in enumerate(URLS + URLS[3:5]):
        assert rows[k] == brute(u, RULES), u


def test_cascade_is_exact(spark):
    listed = spark.range(0, 300).selectExpr("concat('k', id) AS key")
    universe = spark.range(0, 6000).selectExpr("concat('k', id) AS key")
    levels = U.build_cascade(listed, universe, 6000)
    assert len(levels) > 1
    found = universe.where(U.is_listed(U.F.col("key"), levels)).collect()
    assert {r.key for r in found} == {f"k{k}" for k in range(300)}
    assert sum(level.bits for level in levels) < 300 * 40


def test_no_rules_no_rows(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(none, RULES).count() == 0
    assert {r.verdict for r in U.judge(spark.createDataFrame([(1, "a://b/")], "page_id long, url string"), []).collect()} == {"allow"}
    with pytest.raises(ValueError):
        U.judge(none, [("a", "/", "block"), ("a", "/", "allow")])
