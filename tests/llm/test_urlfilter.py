from midbase.llm import urlfilter

PAGES = [
    (1, "http://a.example.com/en/1", '<link rel="canonical" href="http://b.example.com/de/9">'),
    (2, "https://b.example.com/de/9?utm_source=x#top", None),
    (3, "http://c.org/x", "<META http-equiv='refresh' content='0; URL=http://a.example.com/en/1'>"),
    (4, "http://D.ORG/fr/x", '<link href="http://e.org/y" rel=canonical>'),
    (5, "http://e.org/y", '<meta property="og:url" content="//bad.net/z">'),
    (6, "http://bad.net/z", ""),
    (7, None, "<link rel=canonical href=/x>"),
    (8, "no scheme", None),
    (9, "http://example.net/en/1", ""),
    (10, "http://www.example.net/de/1", ""),
    (11, "http://example.com", ""),
    (12, "http://f.org/a/b", '<link rel="canonical" href="c">'),
    (13, "http://f.org/a/c", '<link rel="canonical" href="http://xnet.com/de/">'),
    (13, "http://f.org/a/c", '<link rel="canonical" href="http://xnet.com/de/">'),
    (None, "ftp://u@notexample.com/de/?q=://x", ""),
]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("host", "rule", "node", "u", "v", "label", "id", "hit", "own"):
        df = df.withColumn(c, df.url)
    return df


def test_rules_and_classes(spark):
    got = sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(frame(spark, PAGES)).collect())
    want = [
        (1, "a.example.com", "/en/1", None, "block"),  # canonical is a blocked url
        (2, "b.example.com", "/de/9", "example.com/de/", "block"),
        (3, "c.org", "/x", None, "block"),  # redirects to 1
        (4, "d.org", "/fr/x", "org/fr/", "allow"),
        (5, "e.org", "/y", None, "allow"),  # one class with 4 (allowed) and 6 (blocked): allow goes first
        (6, "bad.net", "/z", "net/", "block"),
        (7, "", "", None, "allow"), (8, "", "", None, "allow"),
        (9, "example.net", "/en/1", "example.net/en/", "allow"), (10, "www.example.net", "/de/1", "net/", "block"),
        (11, "example.com", "", None, "allow"), (12, "f.org", "/a/b", None, "allow"), (13, "f.org", "/a/c", None, "allow"), (13, "f.org", "/a/c", None, "allow"),
        (None, "u@notexample.com", "/de/", None, "allow"),
    ]
    assert got == sorted((str(a), *b) for a, *b in want)
    assert urlfilter.filter_urls(frame(spark, [])).count() == 0


def test_hub(spark):
    rows = [(i, f"http://s{i}.com/", '<link rel="canonical" href="http://hub.example.com/de/">') for i in range(300)]
    assert {r.verdict for r in urlfilter.filter_urls(frame(spark, rows)).collect()} == {"block"}


def test_escaped_targets(spark):
    """In HTML a url's & is written &amp; (or by number); edges go to the url that is meant."""
    blocked = "https://bad.net/p?a=1&b=2"
    ways = [
        '<link rel="canonical" href="https://bad.net/p?a=1&amp;b=2">',
        "<link rel=canonical href=https://bad.net/p?a=1&#38;b=2>",
        '<meta property="og:url" content="https:&#x2F;&#47;bad.net/p?a=1&#x26;b=2">',
        '<meta http-equiv="refresh" content="0; url=https://bad.net/p?a=1&amp;b=2">',
        '<link rel="canonical" href="https://bad.net/p?a=1&b=2">',
    ]
    rows = [(i, f"http://s{i}.com/", html) for i, html in enumerate(ways)]
    # an alias in a stored page's own query: the class is found by the address alone
    rows += [(10, "http://h.com/p?a=1&b=2", '<link rel="canonical" href="http://bad.net/q">'), (11, "http://s11.com/", '<link rel="canonical" href="http://h.com/p?a=1&amp;b=2">')]
    rows += [(20, blocked, ""), (21, "http://s21.com/", '<link rel="canonical" href="http://h.com/p?a=1&amp;amp;b=2">')]
    got = {r.page_id: r.verdict for r in urlfilter.filter_urls(frame(spark, rows)).collect()}
    assert got == {i: "allow" if i == 21 else "block" for i in got}
    texts = ["a&amp;lt;b", "&#38;#38;", "&lt;&gt;&quot;&apos;", "&#233;&#x1F642;&#0;&#xD800;&#9999999;&copy;&", "plain", "", None, "&amp;"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    from pyspark.sql import functions as F

    assert [r.x for r in df.select("i", urlfilter.unescaped(F.col("t")).alias("x")).orderBy("i").collect()] == [
        "a&lt;b", "&#38;", "<>\"'", "é🙂&#0;&#xD800;&#9999999;&copy;&", "plain", "", None, "&",
    ]
