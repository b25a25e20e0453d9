import numpy as np

from corpusloom.llm import url_filter as U

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]


def judged(spark, urls, rules=RULES):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.filter_urls(pages, rules).collect()}


def test_rules_and_edge_cases(spark):
    urls = [
        "https://Example.COM/en/1?x#y", "http://a.www.example.com/en/", "http://example.com/de/", "http://notexample.com/en/",
        "http://x.net/es/1", "http://x.net/fr/1", "http://net/es/", None, "", "no scheme.com/en/", "http://com", "x://y.com?/z", "a://b://c.com/", "http://com/" + "p" * 100000,
    ]
    got = judged(spark, urls)
    assert [got[i] for i in range(14)] == [
        ("example.com", "/en/1", "example.com/en/", "block"), ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("example.com", "/de/", "com/", "allow"), ("notexample.com", "/en/", "com/", "allow"), ("x.net", "/es/1", "net/es/", "block"),
        ("x.net", "/fr/1", None, "allow"), ("net", "/es/", "net/es/", "block"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("com", "", None, "allow"), ("y.com", "", None, "allow"), ("b:", "//c.com/", None, "allow"),
        ("com", "/" + "p" * 100000, "com/", "allow"),
    ]


def test_no_rules_and_no_pages(spark):
    assert judged(spark, ["http://a.com/"], []) == {0: ("a.com", "/", None, "allow")}
    assert judged(spark, []) == {}


def test_cascade_is_exact_over_the_universe(spark):
    keys = [f"key{i}" for i in range(6000)]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    listed = spark.createDataFrame([(k,) for k in keys[:900]] + [(None,), ("key5",)], "key string")
    cascade = U.build_cascade(spark, listed, universe, first_rate=0.3)
    assert len(cascade.levels) > 2
    hashed = universe.select("key", U.key_hashes(universe["key"])[0].alias("a"), U.key_hashes(universe["key"])[1].alias("b")).collect()
    got = cascade.contains(np.array([r["a"] for r in hashed]), np.array([r["b"] for r in hashed]))
    assert {r["key"] for r, g in zip(hashed, got, strict=True) if g} == set(keys[:900])


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(U, "MAX_BITS", 1)
    assert judged(spark, ["http://example.com/en/1", "http://a.org/"])[0][2:] == ("example.com/en/", "block")
