import random

import pytest
from pyspark.sql import functions as F

from strandlake.llm import url_filter as op
from strandlake.llm.queries import RULES

PAGES = [
    (1, "https://www.example.com/en/7?x#y", None),
    (2, "HTTP://Www.EXAMPLE.com/en/8", ""),
    (3, "http://other.de/en/", '<html><link rel="canonical" href="http://www.example.com/en/8"></html>'),
    (4, "http://other.de/a", '<meta http-equiv="refresh" content="0; url=/b">'),
    (5, "http://other.de/b", "<LINK href='http://x.org/es/1' REL='canonical'>"),
    (6, "http://notcom/en/", None),
    (7, None, '<link rel="canonical" href="http://www.example.com/en/8">'),
    (8, "no scheme", None),
    (9, "ftp://a.net/de/", None),
    (10, "ftp://example.net/de/81", None),
    (10, "ftp://example.net/de/81", None),
    (None, "http://host.com", None),
    (11, "http://h.test/1", '<link rel=canonical href=http://h.test/2>'),
    (12, "http://h.test/2", '<link rel="canonical" href="https://sub.example.com/en/70">'),
    (13, "http://h.test/3", '<link rel="canonical" href="http://h.test/2"><meta http-equiv="refresh" content="1;url=http://z.org/es/">'),
    (14, "https://q.test/page/", None),
    (15, "http://q.test/page#top", '<link rel="canonical" href="http://x.org/es/2">'),
]
WANT = {
    1: ("www.example.com", "/en/7", "example.com/en/7", "allow"),
    2: ("www.example.com", "/en/8", "com/en/", "block"),
    3: ("other.de", "/en/", None, "block"),
    4: ("other.de", "/a", None, "block"),
    5: ("other.de", "/b", None, "block"),
    6: ("notcom", "/en/", None, "allow"),
    7: ("", "", None, "allow"),
    8: ("", "", None, "allow"),
    9: ("a.net", "/de/", "net/de/", "allow"),
    10: ("example.net", "/de/81", "example.net/de/8", "block"),
    None: ("host.com", "", None, "allow"),
    11: ("h.test", "/1", None, "allow"),
    12: ("h.test", "/2", None, "allow"),
    13: ("h.test", "/3", None, "allow"),
    14: ("q.test", "/page/", None, "block"),
    15: ("q.test", "/page", None, "block"),
}


def test_rules_and_classes(spark):
    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, node string, component string")
    rows = op.judge(pages, op.rules_frame(spark, RULES)).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == WANT[r["page_id"]], r


def test_redirect_edges_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.test/", None), (2, "http://b.test/", None)], "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://a.test/", "http://hop.test/"), ("http://hop.test/", "http://s.org/es/x"), (None, "http://b.test/")], "a string, b string")
    rules = op.rules_frame(spark, RULES)
    assert {r["page_id"]: r["verdict"] for r in op.judge(pages, rules, redirects).collect()} == {1: "block", 2: "allow"}
    assert op.judge(pages.limit(0), rules).collect() == []
    assert {r["verdict"] for r in op.judge(pages, rules.limit(0), redirects).collect()} == {"allow"}


FORMS = {
    '<link rel="canonical" href="other.html">': "http://h.test/a/other.html",
    '<link rel="canonical" href="../x?y=1">': "http://h.test/x?y=1",
    '<link rel="canonical" href="?id=2">': "http://h.test/a/b?id=2",
    '<link rel="canonical" href="/b?x=1&amp;y=2">': "http://h.test/b?x=1&y=2",
    '<link rel="canonical" href="/b?x=1&#38;y=&#x32;">': "http://h.test/b?x=1&y=2",
    '<link rel="canonical" href="/b?x=&amp;lt;">': "http://h.test/b?x=&lt;",
    '<link rel="alternate canonical" href=//z.test/q>': "http://z.test/q",
    "<link data-x='a > b' href='./c/../d/.' REL=' Canonical '>": "http://h.test/a/d/",
    '<meta content="0;url=\'https://y.test/r\'" http-equiv="Refresh">': "https://y.test/r",
    '<meta http-equiv="refresh" content="3, URL=c.html">': "http://h.test/a/c.html",
    '<meta http-equiv="refresh" content="0; https://y.test/s">': "https://y.test/s",
    '<base href="/z/"><link rel="canonical" href="e">': "http://h.test/z/e",
    '<link rel="canonical" href="/caf&eacute;&#233;&#x1F600;&nosuch;&amp;amp;">': "http://h.test/caf\u00e9\u00e9\U0001f600&nosuch;&amp;",
    "<script>document.write('<link rel=canonical href=\"http://foo.com/en/1\">')</script>": None,
    '<style><link rel=canonical href="/no"></style><link rel=canonical href="/yes">': "http://h.test/yes",
    '<template><link rel=canonical href="/no"></template>': None,
    '<noscript><meta http-equiv="refresh" content="0;url=/no"></noscript>': None,
    '<textarea><link rel=canonical href="/no">': None,
    '<!-- <script> --><link rel=canonical href="/after">': "http://h.test/after",
    '<scripty><link rel=canonical href="/own">': "http://h.test/own",
    '<meta http-equiv="refresh" content="5">': None,
    '<link rel="stylesheet" href="canonical">': None,
    '<link rel="canonical">': None,
    '<link rel="canonical" href="mailto:a@b.test">': None,
    '<!-- <link rel="canonical" href="/no"> -->refresh': None,
    '<meta name="x" content="0;url=/refresh">': None,
}


def test_every_form_of_a_link(spark):
    forms = list(FORMS)
    pages = spark.createDataFrame([("http://h.test/a/b", h) for h in forms], "url string, html string")
    for form in forms:
        got = [r["b"] for r in op.link_edges(pages.where(F.col("html") == form)).collect()]
        assert got == ([FORMS[form]] if FORMS[form] else []), form
    both = '<link rel=canonical href="/1"><link rel=canonical href="/2"><meta http-equiv=refresh content="0;url=/3"><meta http-equiv=refresh content="1;url=/4">'
    got = op.link_edges(spark.createDataFrame([("http://h.test/a", both)], "url string, html string")).collect()
    assert sorted(r["b"] for r in got) == [f"http://h.test/{i}" for i in (1, 2, 3, 4)]


# The examples of RFC 3986, section 5.4, for the base http://a/b/c/d;p?q.
RFC = {
    "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y",
    "g?y": "http://a/b/c/g?y", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "": None, ".": "http://a/b/c/", "./": "http://a/b/c/",
    "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g",
    "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g",
    "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g?y/../x": "http://a/b/c/g?y/../x",
    "g:h": None, "http://o.test/./x/../y": "http://o.test/y",
}


def test_references_are_resolved_as_rfc_3986_says(spark):
    df = spark.createDataFrame(list(RFC.items()), "link string, want string")
    rows = df.select("link", "want", op.resolved(F.lit("http://a/b/c/d;p?q"), F.col("link")).alias("got")).collect()
    assert {r["link"]: r["got"] for r in rows} == RFC


def by_hand(pages, rules):
    """Verdicts by comparing every url with every rule and following links until nothing changes."""
    def own(url):
        host, _, rest = url.split("://", 1)[1].partition("/")
        path = "/" + rest if _ else ""
        fits = [(len(r), v == "allow", r, v) for v, r in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        return max(fits)[3] if fits else None

    group = {u: {u} for u, _ in pages} | {t: {t} for _, ts in pages for t in ts}
    for u, ts in pages:
        for t in ts:
            merged = group[u] | group[t]
            for x in merged:
                group[x] = merged
    out = {}
    for u, _ in pages:
        said = {own(x) for x in group[u]}
        out[u] = own(u) or ("allow" if "allow" in said else "block" if "block" in said else "allow")
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_link_graphs(spark, seed):
    r = random.Random(seed)
    hosts = [f"{a}.{b}" for a in ("x", "y", "www.z") for b in ("com", "net", "org")]
    urls = [f"http://{h}/{p}{i}" for i, (h, p) in enumerate((h, p) for h in hosts for p in ("en/", "de/", "fr/", "es/") for _ in range(3))]
    rules = [("block", "com/en/"), ("allow", "z.com/en/"), ("block", "net/"), ("allow", "y.net/fr/"), ("block", "org/es/7"), ("allow", "x.org/es/")]
    pages = [(u, r.sample(urls, r.choice([0, 0, 1, 1, 2]))) for u in r.sample(urls, 60)]
    rows = [(i, u, "".join(f'<link rel="canonical" href="{t}">' for t in ts)) for i, (u, ts) in enumerate(pages)]
    want = by_hand(pages, rules)
    got = op.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), op.rules_frame(spark, rules)).collect()
    assert {pages[x["page_id"]][0]: x["verdict"] for x in got} == want


def test_very_long_urls_and_pages_and_a_hot_url(spark, monkeypatch):
    from strandlake.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "MOST_HOT", 10)
    long_url = "http://a.example.com/en/8" + "x" * 200_000
    html = "<p>" + "word 'quoted' <b>" * 100_000 + '<link rel="canonical" href="http://s.org/es/1">' + "<a href='" + "y" * 300_000
    rows = [(1, long_url, None), (2, "http://q.test/", html)] + [(10 + i, "http://hot.test/1", None) for i in range(60)] + [(100 + i, f"http://t{i}.test/", None) for i in range(30)]
    got = {r["page_id"]: r for r in op.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), op.rules_frame(spark, RULES)).collect()}
    assert len(got) == len(rows) and got[1]["rule"] == "com/en/" and got[1]["path"] == long_url[len("http://a.example.com") :]
    assert got[2]["verdict"] == "block" and got[10]["verdict"] == "allow"


@pytest.mark.parametrize(
    ("one", "other", "same"),
    [
        ("http://foo.com:80/en/1", "http://foo.com/en/1", True),
        ("https://foo.com:443/en/1/", "http://foo.com:/en/1", True),
        ("http://foo.com:8080/en/1", "http://foo.com/en/1", False),
        ("http://foo.com:443/en/1", "http://foo.com/en/1", False),
        ("http://foo.com/%65n/%7e1", "http://FOO.com/en/~1", True),
        ("http://foo.com/a%2fb", "http://foo.com/a%2Fb", True),
        ("http://foo.com/a%2Fb", "http://foo.com/a/b", False),
        ("http://foo.com/%2565n", "http://foo.com/%65n", False),
        ("http://foo.com/%%36%35", "http://foo.com/%65", False),
        ("http://foo.com/a/../b/./c", "http://foo.com/b/c", True),
        ("http://foo.com/x?q=%41", "http://foo.com/x?q=A", True),
        ("http://foo.com/%C3%A9", "http://foo.com/%c3%a9", True),
    ],
)
def test_equivalent_urls(spark, one, other, same):
    r = spark.createDataFrame([(one, other)], "a string, b string").select(op.resource(F.col("a")), op.resource(F.col("b"))).first()
    assert (r[0] == r[1]) == same, r


def test_a_script_cannot_block_a_page(spark):
    page = "<script>document.write('<link rel=canonical href=\"http://foo.com/en/1\">')</script>"
    pages = spark.createDataFrame([(1, "http://ok.test/", page), (2, "http://ok.test/2", '<link rel=canonical href="http://foo.com:80/%65n/1">'), (3, "http://foo.com/en/1", None)], "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in op.judge(pages, op.rules_frame(spark, RULES)).collect()} == {1: "allow", 2: "block", 3: "block"}


def test_no_table_that_grows_is_sent(spark, monkeypatch):
    """Only rules, and hot keys, go through the driver, however small Spark takes the files of urls to be."""
    plans, store = {}, op.materialize

    def kept(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return store(df, label)

    monkeypatch.setattr(op, "materialize", kept)
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    op.judge(frame, op.rules_frame(spark, RULES)).collect()
    assert plans["url-decided"].count("BroadcastExchange") <= 1  # the rules
    assert not any("BroadcastExchange" in plans[label] for label in ("url-links", "url-judged"))
