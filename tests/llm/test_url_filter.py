import random
import re

import duckdb
import pytest

from caselode.llm import url_filter

SCHEMA = "page_id long, url string, html string"


def canonical(to):
    return f'<html><head><LINK class=x rel="shortcut Canonical" href="{to}"></head></html>'


def refresh(to):
    return f"<meta http-equiv='Refresh' content='0; URL={to}'>"


def host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return lower, re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path, rules):
    fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def node(url):
    if not url or "://" not in url:
        return None
    scheme, rest = url.split("://", 1)
    n = len(re.match(r"[^/?#]*", rest)[0])
    return scheme.lower() + "://" + rest[:n].lower() + rest[n:].split("#")[0]


def plain(pages, rules, links):
    """Every page judged with a union-find over all links."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if node(a) and node(b):
            parent[find(node(a))] = find(node(b))
    named = {}
    for x in list(parent):
        action = rule_of(*host_path(x), rules)[1]
        if action:
            named.setdefault(find(x), set()).add(action)
    out = []
    for page, url in pages:
        host, path = host_path(url)
        rule, action = rule_of(host, path, rules)
        if action is None:
            found = named.get(find(node(url)), set()) if node(url) else set()
            action = "allow" if "allow" in found or not found else "block"
        out.append((page, host, path, rule, action))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df.collect()), key=repr)


def in_duckdb(pages):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    return sorted(con.execute(url_filter.ORACLE_SQL).fetchall(), key=repr)


PAGES = [
    (1, "https://a.example.de/x", canonical("http://bad.net/")),  # an alias of a blocked URL
    (2, "https://b.example.de/x", refresh("/y?a=1&amp;b=2#top")),
    (3, "https://B.example.de/y?a=1&b=2", canonical("https://a.example.de/x")),  # two steps from the block
    (4, "https://www.example.net/en/1", canonical("http://bad.net/")),  # allowed by its own rule, so the class is too
    (5, "https://c.example.de/x", canonical("http://worse.net/1")),  # stays blocked: no allow in its class
    (6, "HTTPS://C.example.de/x#part", None),  # the same resource as 5
    (7, "http://bad.net", None),  # an empty path fits no rule
    (8, None, canonical("http://bad.net/")),
    (9, "bad.net/", ""),
    (10, "https://d.example.de/dir/page", "<!-- " + canonical("http://worse.net/1") + " -->"),
    (11, "https://e.example.de/dir/page", canonical("other")),
    (12, "https://e.example.de/dir/other", refresh("//worse.net/1")),
    (13, "https://example.com/de/z", None),
    (13, "https://example.com/de/z", None),
    (None, "http://x.org/fr/", refresh("")),
    (14, "https://f.example.de", canonical("?q")),
    (15, "https://f.example.de?q", canonical("http://worse.net/1")),
    (16, "http://notnet/x", None),
    (17, "http://net/x", None),
]


def test_planted_aliases(spark):
    df = spark.createDataFrame(PAGES, SCHEMA)
    rules = spark.createDataFrame(url_filter.RULES, url_filter.RULE_SCHEMA)
    found = url_filter.judge(df, rules)
    got = {r.page_id: r.verdict for r in found.collect()}
    blocked = {5, 6, 11, 12, 13, 14, 15, 17}
    assert {k for k, v in got.items() if v == "block"} == blocked
    links = [(r.from_url, r.to_url) for r in url_filter.page_links(df).collect()]
    assert ("https://b.example.de/x", "https://b.example.de/y?a=1&b=2#top") in links
    assert rows(found) == plain([(p, u) for p, u, _ in PAGES], url_filter.RULES, links) == in_duckdb(PAGES)


@pytest.mark.parametrize("seed", range(2))
def test_random_links_against_union_find(spark, seed):
    rnd = random.Random(seed)
    hosts = ["a.b.net", "net", "b.net", "x.org", "org", "example.com", "q.de", "r.de", "s.de"]
    url = lambda: f"http://{rnd.choice(hosts)}{rnd.choice(['/', '/en/', '/fr/1', '', '/a/b'])}{rnd.choice(['', '?x', '#f'])}"
    pages = [(i, url()) for i in range(120)]
    rules = [("net", "/", "block"), ("b.net", "/en/", "allow"), ("org", "", "block"), ("x.org", "/fr/", "allow"), ("example.com", "/a", "block")]
    links = [(url(), url()) for _ in range(20)]
    df = spark.createDataFrame([(i, u, None, "z") for i, u in pages], SCHEMA + ", host string")
    given = spark.createDataFrame(links, "from_url string, to_url string")
    for sent in (url_filter.SENT_RULES, 0):  # rules sent to every task, and joined by key
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(url_filter, "SENT_RULES", sent)
            got = url_filter.judge(df, spark.createDataFrame(rules, url_filter.RULE_SCHEMA), given)
            assert rows(got) == plain(pages, rules, links)


def test_a_hub_of_very_many_aliases(spark):
    pages = spark.range(3000).selectExpr(
        "id as page_id", "concat('http://h', id % 1500, '.de/') as url", """'<link rel=canonical href="http://bad.net/hub">' as html"""
    )
    rules = spark.createDataFrame(url_filter.RULES, url_filter.RULE_SCHEMA)
    got = url_filter.judge(pages, rules)
    assert got.groupBy("verdict").count().collect() == [("block", 3000)]
    assert got.select("alias").distinct().count() == 1


def test_empty_tables(spark):
    rules = spark.createDataFrame(url_filter.RULES, url_filter.RULE_SCHEMA)
    assert url_filter.judge(spark.createDataFrame([], SCHEMA), rules).collect() == []
    page = spark.createDataFrame([(1, "http://a.net/" + "x" * 100_000, "y" * 2_000_000)], SCHEMA)
    assert rows(url_filter.judge(page, rules))[0][3:] == ("net/", "block")
    assert rows(url_filter.judge(page, rules.limit(0)))[0][3:] == (None, "allow")
