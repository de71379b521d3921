"""Scans: registry, feeds, sitemaps, listings, source state."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.catalog import tables as t
from gleaner.catalog.oracle_tables import iso
from gleaner.catalog.registry import query
from gleaner.schemas import RAW_BODIES
from gleaner.sources import discovery, feeds, listings, registry, sitemaps, state

HUB = "https://default.example.org/"


@query("SELECT position, name, type, url FROM sources WHERE enabled AND has_feed")
def enabled_sources(spark, sf):
    return registry.enabled_feeds(t.sources(spark, sf)).select("position", "name", "feed.type", "feed.url")


@query("""
    SELECT position, array_to_string(list_filter([
        CASE WHEN display = 'huge' THEN 'display is unknown' END,
        CASE WHEN has_feed AND type = 'gopher' THEN 'feed.type is unknown' END,
        CASE WHEN has_feed AND type IN ('direct', 'sitemap', 'listing') AND url IS NULL THEN 'feed.url is required' END,
        CASE WHEN has_feed AND type IN ('direct', 'sitemap', 'listing') AND url LIKE 'ftp:%' THEN 'feed.url must be an http or https URL' END,
        CASE WHEN has_feed AND type = 'rsshub' AND route IS NULL THEN 'feed.route is required' END,
        CASE WHEN has_feed AND type = 'rsshub' AND route LIKE '//%' THEN 'feed.route must be an absolute path' END,
        CASE WHEN has_feed AND type = 'listing' AND link_selector = ' ' THEN 'feed.link_selector is required' END,
        CASE WHEN has_feed AND type = 'listing' AND base_url IS NOT NULL THEN 'feed.base_url must be an http or https URL' END
      ], lambda x: x IS NOT NULL), '|') AS violations
    FROM sources""")
def registry_violations(spark, sf):
    return registry.with_violations(t.sources(spark, sf)).select("position", "violations")


@query("""
    SELECT position,
      CASE WHEN NOT has_feed OR type IN ('listing', 'gopher') THEN NULL
           WHEN type = 'rsshub' THEN CASE WHEN instance IS NULL THEN 'https://default.example.org' ELSE 'https://hub.example.org' END
             || COALESCE(route, '') || '?q=' || n_name || '+~%2A%26&full+text=True'
           ELSE COALESCE(url, '') END AS feed_url,
      CASE WHEN NOT has_feed THEN 'source feed is required' WHEN type = 'listing' THEN 'listing is disabled'
           WHEN type = 'gopher' THEN 'unsupported feed type: gopher' END AS feed_error
    FROM sources""")
def feed_urls(spark, sf):
    return registry.with_feed_url(t.sources(spark, sf), HUB, listing_enabled=False).select(
        "position", "feed_url", "feed_error"
    )


@query(f"""
    SELECT 'manual' AS source_name, 'https://manual.example.com/' || n_nationkey AS title,
           'https://manual.example.com/' || n_nationkey AS url, CAST(NULL AS VARCHAR) AS published_at, 'top' AS source_tags
    FROM nation
    UNION ALL
    SELECT name, CASE WHEN i % 2 = 0 THEN 'Manual ' || i ELSE host || 'm' || i END, host || 'm' || i,
           CASE WHEN i % 2 = 0 THEN '2024-02-03T00:00:00Z' END, tags || '|hand'
    FROM sources JOIN (VALUES (1), (2), (3)) AS v(i) ON i <= k % 3 + 1 WHERE enabled""")
def manual_candidates(spark, sf):
    none = F.lit(None).cast("string")
    top = t.read(spark, sf, "nation").select(
        F.col("n_nationkey").alias("position"),
        F.concat(F.lit("https://manual.example.com/"), F.col("n_nationkey").cast("string")).alias("url"),
        none.alias("title"), none.alias("published_at"), F.array(F.lit("top")).alias("tags"),
    )
    return registry.manual_candidates(t.sources(spark, sf), top).select(
        "source_name", "title", "url", "published_at", "source_tags"
    )


def _xml(value):
    """Escape text for an XML element."""
    return F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def feed_bodies(spark, sf):
    """One feed per document: RSS, Atom or RSS with full content; some cut off."""
    k = F.col("doc_id")
    n, body, day = k.cast("string"), _xml(F.col("text")), F.lit("2024-01-01").cast("timestamp") + t.days((k % 100).cast("int"))
    rss = F.concat(
        F.lit("<?xml version='1.0'?><rss version='2.0'><channel><title>f</title><item><title>Doc\x08 &amp; "), n,
        F.lit("</title><link>/d/"), n, F.lit("</link><pubDate>"), F.date_format(day, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"),
        F.lit("</pubDate><description>"), body, F.lit("</description></item><item><title>lost</title></item></channel></rss>"),
    )
    atom = F.concat(
        F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>Atom "), n, F.lit("</title><link rel='self' href='/no'/>"
        "<link href='https://example.com/a/"), n, F.lit("'/><updated>"), F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("</updated><summary>"), body, F.lit("</summary></entry></feed>"),
    )
    full = F.concat(
        F.lit("<rss xmlns:content='http://purl.org/rss/1.0/modules/content/'><channel><item><guid>https://example.com/g/"), n,
        F.lit("</guid><description>short</description><content:encoded><![CDATA[<div><p>"), body,
        F.lit("</p><script>x()</script><b>end</b></div>]]></content:encoded></item></channel></rss>"),
    )
    form = F.element_at(F.array(rss, atom, full), (k % 3 + 1).cast("int"))
    return t.read(spark, sf, "documents").select(
        k.alias("position"),
        F.col("source").alias("source_name"),
        F.array("lang").alias("source_tags"),
        F.lit("https://example.com/blog/").alias("site_url"),
        F.lit(None).cast("string").alias("feed_url"),
        F.when(k % 13 == 0, F.left(form, F.length(form) - 9)).otherwise(form).alias("body"),
    )


_TRIM = "trim(text, ' ' || chr(9) || chr(10) || chr(13))"


@query(f"""
    SELECT doc_id * 4294967296 AS ordinal, source AS source_name,
           CASE doc_id % 3 WHEN 0 THEN 'Doc & ' || doc_id WHEN 1 THEN 'Atom ' || doc_id ELSE 'https://example.com/g/' || doc_id END AS title,
           CASE doc_id % 3 WHEN 0 THEN 'https://example.com/d/' || doc_id WHEN 1 THEN 'https://example.com/a/' || doc_id
             ELSE 'https://example.com/g/' || doc_id END AS url,
           CASE WHEN doc_id % 3 < 2 THEN {iso("TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 100 AS INTEGER))")} END AS published_at,
           lang AS source_tags,
           CASE WHEN doc_id % 3 < 2 THEN 'summary' ELSE 'content' END AS field,
           CASE WHEN doc_id % 3 = 2 THEN 'text/html' END AS content_type,
           CASE WHEN doc_id % 3 < 2 THEN {_TRIM} ELSE {_TRIM} || chr(10) || 'end' END AS source_content
    FROM documents WHERE doc_id % 13 <> 0""")
def feed_entries(spark, sf):
    entries = feeds.feed_entries(feeds.parse_feeds(feed_bodies(spark, sf)))
    meta = F.col("source_content_metadata")
    return entries.select(
        "ordinal", "source_name", "title", "url", "published_at", "source_tags",
        meta["field"].alias("field"), F.try_element_at(meta, F.lit("content_type")).alias("content_type"), "source_content",
    )


@query("""
    SELECT source AS source_name, COUNT(*) AS bodies, COUNT(*) FILTER (WHERE doc_id % 13 = 0) AS failed
    FROM documents GROUP BY source""")
def feed_failures(spark, sf):
    """A broken body is a row of its own and never stops the others."""
    parsed = feeds.parse_feeds(feed_bodies(spark, sf))
    return parsed.groupBy("source_name").agg(
        F.count(F.lit(1)).alias("bodies"), F.count_if(F.col("parse_error").isNotNull()).alias("failed")
    )


def _urlset(url, day=None):
    node = [F.lit("<url><loc> "), _xml(url), F.lit(" </loc>")]
    if day is not None:
        node += [F.lit("<lastmod>"), F.date_format(day, "yyyy-MM-dd"), F.lit("</lastmod>")]
    return F.concat(
        F.lit('<?xml version="1.0"?><!-- map --><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), *node,
        F.lit("</url><url><loc> </loc></url></urlset>"),
    )


@query(f"""
    SELECT page_id, url AS title, url, {iso("TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 50 AS INTEGER))")} AS published_at
    FROM pages WHERE page_id % 11 <> 0""")
def sitemap_entries(spark, sf):
    p = F.col("page_id")
    body = _urlset(F.col("url"), F.lit("2024-01-01").cast("timestamp") + t.days((p % 50).cast("int")))
    prefixed = F.regexp_replace(F.replace(body, F.lit("xmlns="), F.lit("xmlns:m=")), r"<(/?)(url|loc|last)", "<$1m:$2")
    form = F.when(p % 11 == 0, F.lit("<rss/>")).when(p % 3 == 0, prefixed).otherwise(body)
    parsed = sitemaps.parse_sitemaps(t.read(spark, sf, "pages").select("page_id", form.alias("body")))
    return sitemaps.sitemap_entries(parsed, "page_id").select("page_id", "title", "url", "published_at")


def _index(names):
    return F.concat(
        F.lit("<sitemapindex>"),
        F.array_join(F.transform(names, lambda n: F.concat(F.lit("<sitemap><loc>"), n, F.lit("</loc></sitemap>"))), ""),
        F.lit("</sitemapindex>"),
    )


def sitemap_tables(spark, sf):
    """Sitemap trees over runs of ten pages (four shapes) and of a hundred pages (too wide)."""
    pages = t.read(spark, sf, "pages").select("page_id", "url")
    leaf = F.concat(F.lit("leaf-"), F.col("page_id").cast("string"))
    group = F.floor(F.col("page_id") / 10)
    leaves = pages.filter((group % 4 != 2) | (F.col("page_id") % 10 != 3)).select(
        leaf.alias("url"), _urlset(F.col("url")).alias("body")
    )

    def listed(size, pages=pages):
        return pages.groupBy(F.floor(F.col("page_id") / size).alias("g")).agg(
            F.transform(F.array_sort(F.collect_list("page_id")), lambda p: F.concat(F.lit("leaf-"), p.cast("string"))).alias("names")
        )

    g = F.col("g").cast("string")
    one = lambda prefix: F.array(F.concat(F.lit(prefix), g))
    shape = F.col("g") % 4
    below = F.when(shape == 1, F.array(F.struct(F.concat(F.lit("mid-"), g).alias("url"), _index(F.col("names")).alias("body")))).when(
        shape == 3,
        F.array(
            F.struct(F.concat(F.lit("a-"), g).alias("url"), _index(one("b-")).alias("body")),
            F.struct(F.concat(F.lit("b-"), g).alias("url"), _index(one("c-")).alias("body")),
            F.struct(F.concat(F.lit("c-"), g).alias("url"), _index(F.col("names")).alias("body")),
        ),
    ).otherwise(F.array().cast("array<struct<url:string,body:string>>"))
    tens = listed(10)
    root = F.when(shape == 1, _index(one("mid-"))).when(shape == 3, _index(one("a-"))).otherwise(_index(F.col("names")))
    roots = tens.select(F.concat(F.lit("root-"), g).alias("url"), root.alias("body"))
    # every other wide tree lists only what is there
    gone = (F.floor(F.col("page_id") / 100) % 2 == 1) & (group % 4 == 2) & (F.col("page_id") % 10 == 3)
    wide = listed(100, pages.filter(~gone)).select(F.concat(F.lit("wide-"), g).alias("url"), _index(F.col("names")).alias("body"))
    documents = leaves.unionByName(tens.select(F.explode(below).alias("d")).select("d.*"))
    sources = roots.unionByName(wide).select(F.concat(F.lit("source-"), "url").alias("source_name"), "url", "body")
    return sources, documents


_WIDE = """
    listed AS (SELECT page_id, url, page_id // 100 AS w, (page_id // 10) % 4 = 2 AND page_id % 10 = 3 AS gone FROM pages),
    wide AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY w ORDER BY page_id) AS visit FROM listed WHERE NOT (w % 2 = 1 AND gone)),
    ends AS (SELECT w, MIN(visit) FILTER (WHERE gone AND visit <= 32) AS lost, MIN(page_id) FILTER (WHERE gone) AS page, COUNT(*) AS n FROM wide GROUP BY w)
"""


@query(f"""
    WITH {_WIDE}
    SELECT 'source-root-' || (page_id // 10) AS source_name,
           CAST(page_id % 10 + CASE WHEN (page_id // 10) % 4 = 1 THEN 2 ELSE 1 END AS INTEGER) AS visit, url
    FROM pages WHERE (page_id // 10) % 4 < 2
    UNION ALL
    SELECT 'source-wide-' || w, CAST(visit AS INTEGER), url FROM wide JOIN ends USING (w) WHERE lost IS NULL AND n < 32""")
def sitemap_expansion(spark, sf):
    entries, _ = sitemaps.expand_sitemaps(*sitemap_tables(spark, sf))
    return entries.select("source_name", "visit", "url")


@query(f"""
    WITH {_WIDE}
    SELECT 'source-root-' || g AS source_name,
           CASE g % 4 WHEN 2 THEN 'sitemap document not found: leaf-' || (g * 10 + 3)
                      ELSE 'sitemap nesting too deep: leaf-' || (g * 10) END AS error
    FROM (SELECT DISTINCT page_id // 10 AS g FROM pages) t
    WHERE g % 4 = 3 OR (g % 4 = 2 AND EXISTS (SELECT 1 FROM pages WHERE page_id = g * 10 + 3))
    UNION ALL
    SELECT 'source-wide-' || w, CASE WHEN lost IS NULL THEN 'sitemap expansion limit exceeded' ELSE 'sitemap document not found: leaf-' || page END
    FROM ends WHERE lost IS NOT NULL OR n > 31""")
def sitemap_failures(spark, sf):
    _, failed = sitemaps.expand_sitemaps(*sitemap_tables(spark, sf))
    return failed


@query("""
    WITH anchors AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+') AS origin,
                            regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
                            regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS texts FROM pages),
         hits AS (SELECT page_id, origin, unnest(hrefs) AS href, unnest(texts) AS text, generate_subscripts(hrefs, 1) - 1 AS pos FROM anchors)
    SELECT page_id, CAST(pos AS INTEGER) AS pos, trim(replace(text, '&amp;', '&')) AS title, origin || replace(href, '&amp;', '&') AS url
    FROM hits WHERE origin LIKE '%.com' OR origin LIKE '%.net' OR href LIKE '/the%'""")
def listing_links(spark, sf):
    none = F.lit(None).cast("string")
    frame = t.read(spark, sf, "pages").select(
        "page_id",
        F.col("html").alias("body"),
        F.struct(
            F.col("url").alias("url"), F.lit("nav ul li a").alias("link_selector"), none.alias("title_selector"),
            F.array(F.lit(".com/"), F.lit(" .net/ "), F.lit("org/the")).alias("url_patterns"), none.alias("base_url"),
        ).alias("feed"),
    )
    return listings.listing_entries(listings.parse_listings(frame), "page_id").withColumnRenamed("at", "pos")


@query(f"""
    WITH o AS (SELECT k, 'e' || k AS etag, CASE WHEN k % 2 = 0 THEN 'm' || k END AS modified, TIMESTAMP '2024-01-01' AS checked FROM sources WHERE k % 3 <> 0),
         n AS (SELECT k, CASE WHEN k % 4 = 0 THEN 'n' || k END AS etag, TIMESTAMP '2024-02-01' AS checked FROM sources WHERE k % 2 = 0)
    SELECT 'source ' || COALESCE(n.k, o.k) AS source_name, COALESCE(n.etag, o.etag) AS etag, o.modified AS modified,
           CASE WHEN n.k IS NULL THEN 'success' WHEN n.k % 5 = 0 THEN 'failed' ELSE 'not_modified' END AS last_status,
           CASE WHEN n.k % 5 = 0 THEN 'timeout' END AS last_error, {iso("COALESCE(n.checked, o.checked)")} AS checked_at
    FROM o FULL JOIN n ON o.k = n.k""")
def source_state_merge(spark, sf):
    k = F.col("s_suppkey")
    name, none = F.concat(F.lit("source "), k.cast("string")).alias("source_name"), F.lit(None).cast("string")

    def tagged(prefix, when):
        return F.when(when, F.concat(F.lit(prefix), k.cast("string")))

    supplier = t.read(spark, sf, "supplier").select("s_suppkey")
    old = supplier.filter(k % 3 != 0).select(
        name, tagged("e", F.lit(True)).alias("etag"), tagged("m", k % 2 == 0).alias("modified"),
        F.lit("success").alias("last_status"), none.alias("last_error"),
        F.lit("2024-01-01").cast("timestamp").alias("checked_at"),
    )
    new = supplier.filter(k % 2 == 0).select(
        name, tagged("n", k % 4 == 0).alias("etag"), none.alias("modified"),
        F.when(k % 5 == 0, "failed").otherwise("not_modified").alias("last_status"),
        F.when(k % 5 == 0, F.lit("timeout")).alias("last_error"),
        F.lit("2024-02-01").cast("timestamp").alias("checked_at"),
    )
    return state.merge_source_state(old, new)


def polled_sources(spark, sf):
    """Registry with addresses, and one response per polled source."""
    registered = registry.with_feed_url(t.sources(spark, sf), HUB)
    k, kind = F.col("position"), F.col("feed.type")
    link = F.concat(F.lit("https://s"), k.cast("string"), F.lit(".example.com/a"))
    rss = F.concat(F.lit("<rss><channel><item><link>"), link, F.lit("</link></item></channel></rss>"))
    body = (
        F.when(kind == "sitemap", _urlset(link))
        .when(kind == "listing", F.concat(F.lit('<p><a href="'), link, F.lit('">text</a><a href="#x">no</a></p>')))
        .when(k % 9 == 0, F.left(rss, F.lit(30)))
        .otherwise(rss)
    )
    none = F.lit(None).cast("string")
    bodies = registered.filter(F.col("feed").isNotNull() & (k % 8 != 2)).select(
        F.col("name").alias("source_name"),
        body.alias("body"),
        F.when(k % 8 == 0, 304).when(k % 8 == 1, 500).otherwise(200).alias("http_status"),
        F.concat(F.lit("e"), k.cast("string")).alias("etag"),
        none.alias("modified"),
        none.alias("fetch_error"),
    ).to(_schema(spark, RAW_BODIES))
    nothing = spark.createDataFrame([], "url string, body string")
    return discovery.read_sources(registered, bodies, nothing, F.lit("2024-03-01").cast("timestamp"))


def _schema(spark, ddl):
    return spark.createDataFrame([], ddl).schema


_POLLED = """
    polled AS (SELECT name, k, host, tags, CASE
                 WHEN type = 'gopher' THEN 'unsupported feed type: gopher'
                 WHEN k % 8 = 2 THEN 'no response' WHEN k % 8 = 1 THEN 'HTTP status 500' WHEN k % 8 = 0 THEN NULL
                 WHEN type IN ('direct', 'rsshub') AND k % 9 = 0 THEN 'feed parse failed'
                 WHEN type = 'listing' AND link_selector = ' ' THEN 'unsupported selector:  ' END AS error,
               k % 8 = 0 AND type <> 'gopher' AS unchanged
               FROM sources WHERE enabled AND has_feed)"""


@query(f"""
    WITH {_POLLED}
    SELECT name AS source_name, CASE WHEN error IS NULL AND NOT unchanged THEN 'e' || k END AS etag,
           CASE WHEN error IS NOT NULL THEN 'failed' WHEN unchanged THEN 'not_modified' ELSE 'success' END AS last_status,
           error AS last_error
    FROM polled""")
def discovery_states(spark, sf):
    _, states = polled_sources(spark, sf)
    return states.select("source_name", "etag", "last_status", "last_error")


@query(f"""
    WITH {_POLLED}
    SELECT name AS source_name, host || 'a' AS url, tags AS source_tags FROM polled WHERE error IS NULL AND NOT unchanged""")
def discovery_entries(spark, sf):
    entries, _ = polled_sources(spark, sf)
    return entries.select("source_name", "url", "source_tags")
