import random

import pytest

from gatehouse.llm import queries, url_filter
from gatehouse.llm.url_filter import HostPathTrie, Rule, split_url


def plain(rules, host, path):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (r.host.count("."), len(r.path)), default=None)
    return (best.text, best.action) if best else (None, "allow")


def test_split_url():
    assert split_url(None) == split_url("") == split_url("no scheme/x") == ("", "")
    assert split_url("http://Ex.COM") == ("ex.com", "")
    assert split_url("http://a.b/c/D?e=/f#g") == ("a.b", "/c/D")
    assert split_url("x://h?q=a/b") == ("h", "") and split_url("x://h#/b") == ("h", "")
    assert split_url("http://a.b/c://d/e") == ("a.b", "/c://d/e")
    assert split_url("://É.org/") == ("É.org", "/")


def test_trie_against_plain_version():
    rng = random.Random(0)
    hosts = ["com", "a.com", "b.a.com", "net", "c.net", "xa.com"]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/7/x", "/e", "/en//", "/de/8"]
    for _ in range(200):
        rules = list({(h, p): Rule(rng.choice(["allow", "block"]), h, p) for h, p in ((rng.choice(hosts), rng.choice(paths)) for _ in range(6))}.values())
        trie = HostPathTrie(rules)
        for _ in range(40):
            host, path = rng.choice([*hosts, "", "z.c.net", "com.evil", "acom"]), rng.choice([*paths, "/en/79", "/en/7/xy", "/english"])
            assert trie.judge(host, path) == plain(rules, host, path), (rules, host, path)


def test_table(spark):
    rows = [(1, "http://www.example.com/en/79", "x"), (2, None, "x"), (3, "", "x"), (4, "http://example.net/de/8#a", "x"), (4, "http://example.net/de/8#a", "x"), (5, "http://q.org/" + "es/" * 5000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = url_filter.filter_urls(pages, queries.RULES)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    found = {r.page_id: (r.rule, r.verdict) for r in got.collect()}
    assert found == {1: ("example.com/en/7", "allow"), 2: (None, "allow"), 3: (None, "allow"), 4: ("example.net/de/8", "block"), 5: ("org/es/", "block")}
    assert url_filter.filter_urls(pages.limit(0), queries.RULES).collect() == []
    with pytest.raises(ValueError):
        HostPathTrie([Rule("drop", "a")])


def test_rules_without_a_host_and_urls_without_one(spark):
    rules = [Rule("block", "com", "/"), Rule("allow", "a.com", "/x")]
    pages = spark.createDataFrame([(1, ":///x"), (2, "://"), (3, "no scheme"), (4, "://a.com"), (5, "://b.a.com/x?y")], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == {1: ("", "/x", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("a.com", "", None, "allow"), 5: ("b.a.com", "/x", "a.com/x", "allow")}
