import random

from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.sources import discovery, feeds, listings, registry, sitemaps, state

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>
<item><title>One\x08</title><link>/blog/one</link><pubDate>Mon, 02 Jun 2025 10:00:00 GMT</pubDate>
<description>plain</description></item>
<item><title>No link</title></item>
<item><guid>https://example.com/two</guid><description>&lt;p&gt;sum&lt;/p&gt;</description>
<content:encoded><![CDATA[<p>full <b>text</b></p>]]></content:encoded></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="self" href="/self"/>
<link href="https://example.com/a"/><updated>2025-06-02T00:00:00Z</updated><summary>s</summary></entry></feed>"""


def urlset(*nodes):
    rows = "".join(f"<url><loc>{u}</loc>{f'<lastmod>{d}</lastmod>' if d else ''}</url>" for u, d in nodes)
    return f'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{rows}</urlset>'


def index(*urls):
    return "<sitemapindex>" + "".join(f"<sitemap><loc> {u} </loc></sitemap>" for u in urls) + "</sitemapindex>"


def test_registry_reading(spark, tmp_path):
    path = tmp_path / "sources.yaml"
    path.write_text(
        """
sources:
  - name: a
    tags: [x]
    feed: {type: rsshub, route: /r/1, params: {full: true, q: "a b~*", n: 3}}
    manual_urls: [https://e.com/m, {url: https://e.com/n, title: N, tags: [y], published_at: 2025-01-02}]
  - name: b
    enabled: false
    feed: {type: direct, url: "https://e.com/feed"}
    manual_urls: [https://e.com/off]
  - {name: c, feed: {type: listing, url: "https://e.com/l", link_selector: " ", color: red}, mood: good}
manual_urls: [https://e.com/top]
""",
        encoding="utf-8",
    )
    sources, manual = registry.read_registry(spark, str(path))
    built = registry.with_feed_url(sources, "https://hub.org/", listing_enabled=False)
    assert {r.name: (r.feed_url, r.feed_error) for r in built.collect()} == {
        "a": ("https://hub.org/r/1?full=True&q=a+b~%2A&n=3", None),
        "b": ("https://e.com/feed", None),
        "c": (None, "listing is disabled"),
    }
    assert [r.name for r in registry.enabled_feeds(sources).orderBy("position").collect()] == ["a", "c"]
    rows = registry.manual_candidates(sources, manual).orderBy("ordinal").collect()
    assert [(r.source_name, r.title, r.url, r.source_tags) for r in rows] == [
        ("manual", "https://e.com/top", "https://e.com/top", []),
        ("a", "https://e.com/m", "https://e.com/m", ["x"]),
        ("a", "N", "https://e.com/n", ["x", "y"]),
    ]
    assert rows[2].published_at.isoformat() == "2025-01-02T00:00:00"
    broken = {r.name: r.violations for r in registry.with_violations(sources).collect()}
    assert broken == {"a": [], "b": [], "c": ["feed.link_selector is required", "unknown keys"]}


def test_registry_rules(spark):
    feed = "named_struct('type','{}','url',{},'route',{},'instance',{},'params',map({}),'link_selector','a'," \
           "'title_selector',null,'url_patterns',array(),'base_url',{})"
    cases = [
        (feed.format("direct", "'ftp://x/y'", "null", "null", "'k','v'", "null"), ["feed.url must be an http or https URL"]),
        (feed.format("direct", "''", "null", "null", "'k','v'", "null"), ["feed.url is required"]),
        (feed.format("rsshub", "null", "'//h/x'", "'hub'", "' ','v'", "null"),
         ["feed.route must be an absolute path", "feed.instance must be an http or https URL",
          "feed.params keys must not be empty"]),
        (feed.format("listing", "'https://e.com'", "null", "null", "'k','v'", "''"),
         ["feed.base_url must be an http or https URL"]),
        (feed.format("gopher", "null", "null", "null", "'k','v'", "null"), ["feed.type is unknown"]),
    ]
    for expression, expected in cases:
        frame = spark.range(1).selectExpr(
            "'n' name", "'default' display", f"{expression} feed", "cast(null as string) site_url",
            f"cast(array() as array<{schemas.MANUAL_URL}>) manual_urls",
        )
        assert registry.with_violations(frame).first().violations == expected


def test_feeds(spark):
    rows = [(0, "s", ["t"], "https://example.com/blog/", None, RSS), (1, "u", [], None, None, ATOM),
            (2, "bad", [], None, None, "<rss><channel>")]
    frame = spark.createDataFrame(
        rows, "position int, source_name string, source_tags array<string>, site_url string, feed_url string, body string"
    )
    parsed = feeds.parse_feeds(frame)
    assert {r.source_name: r.parse_error for r in parsed.collect()} == {"s": None, "u": None, "bad": "feed parse failed"}
    got = feeds.feed_entries(parsed).orderBy("ordinal").collect()
    assert [(r.title, r.url, r.source_content, r.source_content_metadata) for r in got] == [
        ("One", "https://example.com/blog/one", "plain", {"source": "feed_entry", "field": "summary"}),
        ("https://example.com/two", "https://example.com/two", "full\ntext",
         {"source": "feed_entry", "field": "content", "content_type": "text/html"}),
        ("A", "https://example.com/a", "s", {"source": "feed_entry", "field": "summary"}),
    ]
    assert got[0].published_at.isoformat() == "2025-06-02T10:00:00"
    assert got[2].published_at.isoformat() == "2025-06-02T00:00:00"


def expand(spark, roots, documents):
    entries, failed = sitemaps.expand_sitemaps(
        spark.createDataFrame([(s, u, dict(documents)[u]) for s, u in roots], "source_name string, url string, body string"),
        spark.createDataFrame(documents, "url string, body string"),
    )
    return (
        [(r.source_name, r.url) for r in entries.orderBy("source_name", "visit", "at").collect()],
        {r.source_name: r.error for r in failed.collect()},
    )


def walk(documents, root, max_depth, max_files):
    """The walk of one source, document by document."""
    order, seen = [], {root}

    def visit(url, depth):
        if url not in documents:
            raise ValueError(f"sitemap document not found: {url}")
        if depth > max_depth:
            raise ValueError(f"sitemap nesting too deep: {url}")
        if len(order) >= max_files:
            raise ValueError("sitemap expansion limit exceeded")
        order.append(url)
        for child in documents[url]:
            if child not in seen:
                seen.add(child)
                visit(child, depth + 1)

    try:
        visit(root, 0)
    except ValueError as error:
        return str(error)
    return [url for url in order if not documents[url]]


def test_sitemap_walks_of_random_graphs(spark):
    draw = random.Random(4)
    names = [f"n{i}" for i in range(9)]
    for max_depth, max_files in ((3, 32), (2, 5), (8, 9)):
        graph = {name: [draw.choice([*names, "gone"] if draw.random() < 0.03 else names) for _ in range(draw.choice([0, 0, 1, 2, 3]))] for name in names}
        bodies = [(n, index(*links) if links else urlset((f"https://e.com/{n}", None))) for n, links in graph.items()]
        entries, failed = sitemaps.expand_sitemaps(
            spark.createDataFrame([(f"s-{n}", n, dict(bodies)[n]) for n in names], "source_name string, url string, body string"),
            spark.createDataFrame(bodies, "url string, body string"), max_depth=max_depth, max_files=max_files,
        )
        got = {r.source_name: r.error for r in failed.collect()}
        for r in entries.orderBy("source_name", "visit").collect():
            got.setdefault(r.source_name, []).append(r.url.rpartition("/")[2])
        want = {f"s-{n}": walk(graph, n, max_depth, max_files) for n in names}
        assert got == {source: told for source, told in want.items() if told}


def test_a_source_of_very_many_documents(spark):
    n = 100_000
    links = spark.range(n).select(F.concat(F.lit("d"), F.format_string("%06d", "id")).alias("url"))
    leaf = links.select("url", F.concat(F.lit("<urlset><url><loc>https://e.com/"), "url", F.lit("</loc></url></urlset>")).alias("body"))
    whole = index(*[f"d{i:06}" for i in range(n)])
    roots = spark.createDataFrame([("big", "big", whole), ("small", "d000007", urlset(("https://e.com/s", None)))], "source_name string, url string, body string")
    entries, failed = sitemaps.expand_sitemaps(roots, leaf, max_files=None)
    assert failed.count() == 0
    facts = entries.groupBy("source_name").agg(F.count("*").alias("n"), F.sum((F.concat(F.lit("https://e.com/"), F.format_string("d%06d", F.col("visit") - 1)) == F.col("url")).cast("int")).alias("right"))
    assert {r.source_name: (r.n, r.right) for r in facts.collect()} == {"big": (n, n), "small": (1, 0)}
    _, failed = sitemaps.expand_sitemaps(roots, leaf, max_files=n)
    assert [tuple(r) for r in failed.collect()] == [("big", "sitemap expansion limit exceeded")]


def test_sitemaps(spark):
    documents = [
        ("r1", index("m1", "m2", "m1", "r1")), ("m1", urlset(("https://e.com/1", "2026-05-20"))),
        ("m2", urlset(("https://e.com/2", None))),
        ("r2", index("m1", "gone")),
        ("r3", index("d1")), ("d1", index("d2")), ("d2", index("d3")), ("d3", index("m1")),
        ("r4", index(*[f"w{i}" for i in range(32)])), *[(f"w{i}", urlset((f"https://e.com/w{i}", None))) for i in range(32)],
        ("r5", index(*[f"w{i}" for i in range(31)])),
        ("r6", "<html/>"), ("r7", "<urlset><url>"), ("r8", index("r7")),
        # The first path to z is the deep one, so the walk exceeds the depth.
        ("r9", index("y1", "z")), ("y1", index("y2")), ("y2", index("z")), ("z", index("m1")),
    ]
    entries, failed = expand(spark, [(f"s{i}", f"r{i}") for i in range(1, 10)], documents)
    # Two sources may name one address and get different bodies.
    same, _ = sitemaps.expand_sitemaps(
        spark.createDataFrame([("p", "u", urlset(("https://e.com/p", None))), ("q", "u", index("u", "m1"))],
                              "source_name string, url string, body string"),
        spark.createDataFrame(documents[1:2], "url string, body string"),
    )
    assert sorted((r.source_name, r.url) for r in same.collect()) == [("p", "https://e.com/p"), ("q", "https://e.com/1")]
    assert [e for e in entries if e[0] == "s1"] == [("s1", "https://e.com/1"), ("s1", "https://e.com/2")]
    assert len([e for e in entries if e[0] == "s5"]) == 31
    assert {e[0] for e in entries} == {"s1", "s5"}
    assert failed == {
        "s2": "sitemap document not found: gone",
        "s3": "sitemap nesting too deep: m1",
        "s4": "sitemap expansion limit exceeded",
        "s6": "unsupported sitemap root: html",
        "s7": "sitemap parse failed",
        "s8": "sitemap parse failed",
        "s9": "sitemap nesting too deep: m1",
    }


def test_listing(spark):
    page = """<main><article><h2>First</h2><a class="post-link" href="/blog/2024/a">x</a></article>
    <article><h2>Second</h2><a class="post-link" href="#top">y</a></article>
    <article><h2></h2><a class="post-link big" href="https://e.com/blog/2024/b"> B <i>b</i></a></article>
    <article><a class="post-link" href="/blog/2023/c">c</a><a class="post-link" href="mailto:x@y">m</a></article></main>
    <a class="post-link" href="/blog/2024/outside">o</a>"""
    frame = spark.range(1).select(
        F.lit(page).alias("body"),
        F.expr(
            "named_struct('url','https://e.com/list/','link_selector','main article a.post-link',"
            "'title_selector','article h2','url_patterns',array(' /blog/2024 ',''),'base_url',cast(null as string))"
        ).alias("feed"),
    )
    got = listings.listing_entries(listings.parse_listings(frame)).orderBy("at").collect()
    assert [(r.at, r.title, r.url) for r in got] == [
        (0, "First", "https://e.com/blog/2024/a"),
        (2, "Bb", "https://e.com/blog/2024/b"),
    ]


def test_source_state(spark):
    old = spark.createDataFrame([("a", "e1", "m1", "success", None, None), ("b", "e2", None, "failed", "x", None)],
                                schemas.SOURCE_STATE)
    new = spark.createDataFrame([("a", None, "m2", "failed", "boom", None), ("c", None, None, "success", None, None)],
                                schemas.SOURCE_STATE)
    got = {r.source_name: (r.etag, r.modified, r.last_status, r.last_error)
           for r in state.merge_source_state(old, new).collect()}
    assert got == {"a": ("e1", "m2", "failed", "boom"), "b": ("e2", None, "failed", "x"), "c": (None, None, "success", None)}


def test_discovery_isolates_failures(spark, tmp_path):
    config = """{"sources": [
      {"name": "rss", "site_url": "https://example.com/", "tags": ["t"], "feed": {"type": "direct", "url": "https://example.com/f"}},
      {"name": "broken", "feed": {"type": "direct", "url": "https://b.com/f"}},
      {"name": "same", "feed": {"type": "direct", "url": "https://c.com/f"}},
      {"name": "map", "feed": {"type": "sitemap", "url": "https://m.com/s.xml"}},
      {"name": "list", "feed": {"type": "listing", "url": "https://l.com/x", "link_selector": "a"}},
      {"name": "silent", "feed": {"type": "direct", "url": "https://d.com/f"}}]}"""
    sources, _ = registry.parse_registry(spark.createDataFrame([(config,)], "value string"))
    sources = registry.with_feed_url(sources, "https://hub.org", listing_enabled=False)
    bodies = spark.createDataFrame(
        [("rss", RSS, 200, "e", None, None), ("broken", "<rss", 200, None, None, None), ("same", None, 304, None, None, None),
         ("map", index("https://m.com/1.xml"), 200, None, None, None), ("list", "<a href='/x'>x</a>", 200, None, None, None)],
        schemas.RAW_BODIES,
    )
    documents = spark.createDataFrame([("https://m.com/1.xml", urlset(("https://m.com/p", None)))], "url string, body string")
    entries, states = discovery.read_sources(sources, bodies, documents, F.lit("2026-01-01").cast("timestamp"))
    assert sorted((r.source_name, r.url) for r in entries.collect()) == [
        ("map", "https://m.com/p"), ("rss", "https://example.com/blog/one"), ("rss", "https://example.com/two")]
    assert {r.source_name: (r.last_status, r.last_error, r.etag) for r in states.collect()} == {
        "rss": ("success", None, "e"), "broken": ("failed", "feed parse failed", None),
        "same": ("not_modified", None, None), "map": ("success", None, None),
        "list": ("failed", "listing is disabled", None), "silent": ("failed", "no response", None)}


def test_bodies_in_other_character_sets(spark):
    from pyspark.sql import functions as F

    from gleaner.functions.charsets import with_body_text
    from gleaner.sources.listings import parse_listings

    cases = {
        "plain": ("é 标题".encode(), "é 标题"), "gb": ('<?xml version="1.0" encoding="GB2312"?><a>标题</a>'.encode("gb2312"), "标题"),
        "latin": ("<?xml version='1.0' encoding='ISO-8859-1'?><u>/é</u>".encode("latin-1"), "/é"), "wide": ("<a>题</a>".encode("utf-16"), "<a>题</a>"),
        "meta": ('<meta charset=gbk><a href="/x">题</a>'.encode("gbk"), "题"), "marked": (b"\xef\xbb\xbf<a/>", "<a/>"),
        "letter of gbk": ('<?xml version="1.0" encoding="gb2312"?><a>镕</a>'.encode("gbk"), "镕"),
        "quotes": (b'<?xml version="1.0" encoding="iso-8859-1"?><a>\x93x\x94 \x80\x81</a>', "“x” €\x81"),
        "bad": (b"\xff\xfe\x00", None), "liar": (b'<?xml encoding="utf-8"?>\xff', None), "odd": (b'<?xml encoding="x-none"?><a/>', None), "none": (None, None),
    }
    frame = spark.createDataFrame([(name, raw) for name, (raw, _) in cases.items()], "name string, body binary")
    got = {r.name: r._text for r in with_body_text(frame).collect()}
    assert all((got[name] is None) == (text is None) and (text or "") in (got[name] or "") for name, (_, text) in cases.items()), got
    assert got["marked"] == "<a/>"
    text = frame.select("name", F.lit('<?xml encoding="gb2312"?>题').alias("body"))
    assert with_body_text(text).first()._text.endswith("题")
    pages = frame.filter("name IN ('meta', 'bad')").withColumn("feed", F.expr("named_struct('link_selector', 'a', 'title_selector', '')"))
    listed = {r.name: (r.parse_error, r.titles or r.links) for r in parse_listings(pages).collect()}
    assert listed["bad"][0] == "listing body cannot be decoded" and listed["meta"][0] is None
