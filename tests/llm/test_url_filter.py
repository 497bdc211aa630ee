"""URL verdicts against a walk over all links, on small frames."""

import random
import re
from collections import defaultdict

import pytest

from cohortlib.llm import queries
from cohortlib.llm import url_filter as uf

PAGES = "page_id bigint, url string, html string"
RULES = "action string, host string, path string"
LINKS = "src string, dst string"


def parts(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("", "") if not found else ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in found[1]), found[2])


def rule_of(url, rules):
    host, path = parts(url)
    fit = [(len(h + p), a == "allow", h + p, a) for a, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[2:] if fit else (None, None)


def verdicts(urls, rules, links):
    near = defaultdict(set)
    for a, b in links:
        if a is not None and b is not None:
            near[a].add(b)
            near[b].add(a)
    out = []
    for url in urls:
        rule, action = rule_of(url, rules)
        seen, todo = {url}, [url]
        while todo and url is not None:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        blocked = any(rule_of(u, rules)[1] == "block" for u in seen - {None})
        out.append((*parts(url), rule, action or ("block" if blocked else "allow")))
    return out


def judged(spark, urls, rules, links):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGES)
    out = uf.judge(pages, spark.createDataFrame(rules, RULES), spark.createDataFrame(links, LINKS)).collect()
    return [(r.host, r.path, r.rule, r.verdict) for r in sorted(out, key=lambda r: r.page_id)]


def test_parts_and_rules(spark):
    rules = queries.URL_RULES
    urls = ["http://a.example.org/es/1", "http://example.org/en/15?x#y", "https://EXAMPLE.ORG", "http://example.org/", "http://xexample.org/es/", "ftp://b.com/fr/x",
            "http://b.com/de", "http://b.com/de/", "x://y://com/de/z", None, "", "no scheme", "://", "http://com/de/", "http://a.com:80/de/1",
            "http://ÉX.org/é", "http://example.org?/es/", "http://example.org#/es/", "http://a\nb.com/de/1\n2"]
    assert judged(spark, urls, rules, []) == verdicts(urls, rules, [])


def test_longest_rule_and_ties(spark):
    rules = [("block", "b.c", "/x"), ("allow", "b.c", "/x"), ("block", "c", "/x/yz"), ("allow", "a.b.c", "/x"), ("block", None, "/"), ("hide", "c", "/"), ("block", "d", None)]
    urls = ["h://b.c/x", "h://a.b.c/x/yz", "h://q.c/x/yz1", "h://c/", "h://d", "h://e.d/1"]
    assert [r[2:] for r in judged(spark, urls, rules, [])] == [("b.c/x", "allow"), ("a.b.c/x", "allow"), ("c/x/yz", "block"), (None, "allow"), ("d", "block"), ("d", "block")]


def test_blocks_reach_aliases_but_not_explicit_allows(spark):
    rules = [("block", "bad.com", "/"), ("allow", "good.org", "/")]
    links = [("h://a.net/1", "h://b.net/1"), ("h://c.net/1", "h://b.net/1"), ("h://c.net/1", "h://bad.com/1"), ("h://good.org/1", "h://bad.com/1"),
             ("h://d.net/1", "h://e.net/1"), ("h://e.net/1", "h://d.net/1"), ("h://f.net/1", "h://f.net/1"), (None, "h://d.net/1"), ("h://d.net/1", None)]
    urls = ["h://a.net/1", "h://b.net/1", "h://c.net/1", "h://good.org/1", "h://d.net/1", "h://e.net/1", "h://f.net/1", "h://z.net/", "h://a.net/1", None]
    got = judged(spark, urls, rules, links)
    assert got == verdicts(urls, rules, links)
    assert [r[3] for r in got] == ["block"] * 3 + ["allow"] * 5 + ["block", "allow"]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_links(spark, seed):
    r = random.Random(seed)
    urls = [f"http://{r.choice('abcdef')}.{r.choice(['com', 'org', 'net'])}/{r.choice('xyz')}/{i}" for i in range(150)]
    rules = [("block", "a.com", "/x"), ("allow", "a.com", "/x/1"), ("block", "org", "/z/"), ("allow", "net", "/x"), ("block", "b.net", "/")]
    links = [(r.choice(urls), r.choice(urls)) for _ in range(90)] + [("http://out.org/z/", urls[3])]
    assert judged(spark, urls, rules, links) == verdicts(urls, rules, links)


def test_plain_url(spark):
    given = {"https://www.a.com/x/?utm_source=f&b=1#t": "http://a.com/x?b=1", "http://M.a.com/x.html": "http://a.com/x", "http://m.com/": "http://m.com",
             "http://www.a.com/?ref=1&reference=2": "http://a.com?reference=2", "HTTP://a.com/x": "http://a.com/x", "nothing": None, "a://b": "http://b"}
    df = spark.createDataFrame([(u,) for u in given], "url string").select("url", uf.plain_url(uf.F.col("url")).alias("plain"))
    assert {r.url: r.plain for r in df.collect()} == given


def test_links_in_pages(spark):
    html = """<head><LINK href='https://c.com/1?a=1&amp;b=2' rel="Canonical"><link rel=stylesheet href=/s.css>
              <meta http-equiv="Refresh" content="0; URL='/next'"><meta content="3;url=//d.com/2" http-equiv=refresh><link rel=canonical href=rel/path></head>"""
    pages = spark.createDataFrame([(1, "http://a.net/0", html), (2, "http://a.net/0", None), (3, None, html), (4, "x", "<meta http-equiv=refresh content=5>")], PAGES)
    got = {(r.src, r.dst) for r in uf.page_links(pages).collect()}
    assert got == {("http://a.net/0", "https://c.com/1?a=1&b=2"), ("http://a.net/0", "http://a.net/next"), ("http://a.net/0", "http://d.com/2"),
                   ("https://c.com/1?a=1&b=2", "http://c.com/1?a=1&b=2")}


def test_empty_extra_and_long(spark):
    assert judged(spark, [], queries.URL_RULES, []) == []
    assert judged(spark, ["h://a.com/de/1"], [], []) == [("a.com", "/de/1", None, "allow")]
    long = ["http://" + "a." * 20_000 + "com/de/" + "p" * 100_000, "http://x/" + "?" * 100_000, "http://" + "é" * 50_000]
    assert judged(spark, long, queries.URL_RULES, []) == verdicts(long, queries.URL_RULES, [])
    pages = spark.createDataFrame([(1, "h://a.com/de/", "x", "y", 1)], "page_id int, url string, host string, Verdict string, root int")
    out = uf.judge(pages, spark.createDataFrame(queries.URL_RULES, RULES), spark.createDataFrame([], LINKS)).collect()
    assert [r.asDict() for r in out] == [{"page_id": 1, "url": "h://a.com/de/", "root": 1, "host": "a.com", "path": "/de/", "rule": "com/de/", "aliases": False, "verdict": "block"}]
