"""Scalar functions over the given tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from gleaner.catalog import tables as t
from gleaner.catalog.oracle_tables import iso
from gleaner.catalog.registry import query
from gleaner.functions import publishing, text, times, urls
from gleaner.functions.html import markup_text
from gleaner.operators.latest import latest


@query("SELECT ordinal, normalized_url FROM sightings")
def url_normalize(spark, sf):
    return t.sightings(spark, sf).select("ordinal", urls.normalize_url(F.concat(F.lit(" "), "url")).alias("normalized_url"))


@query("""
    WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/]+') AS origin,
                      regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path FROM pages),
         d AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS dir FROM p)
    SELECT page_id, CASE page_id % 8
             WHEN 0 THEN origin || '/x/' || page_id
             WHEN 1 THEN origin || '/blog/' || page_id || '?a=1#b'
             WHEN 2 THEN 'https://other.org/' || page_id
             WHEN 3 THEN origin || dir || 'post-' || page_id
             WHEN 4 THEN origin || regexp_replace(dir, '[^/]+/$', '') || 'up/' || page_id
             WHEN 5 THEN origin || path || '?p=' || page_id
             WHEN 6 THEN regexp_extract(url, '^[^#]*') || '#f' || page_id
             ELSE regexp_extract(url, '^https?:') || '//cdn.org/' || page_id END AS entry_url
    FROM d""")
def url_absolutise(spark, sf):
    p = F.col("page_id").cast("string")
    forms = ["/x/{}", "http://localhost:5174/blog/{}?a=1#b", "https://other.org/{}", "post-{}", "../up/./{}", "?p={}",
             "#f{}", "//cdn.org/{}"]
    link = F.array(*[F.concat(F.lit(f.split("{}")[0]), p, F.lit(f.split("{}")[1])) for f in forms])
    ref = F.element_at(link, (F.col("page_id") % 8 + 1).cast("int"))
    none = F.lit(None).cast("string")
    return t.read(spark, sf, "pages").select(
        "page_id", urls.absolutise_entry_url(ref, F.col("url"), none).alias("entry_url")
    )


def _decomposed(expression: str) -> str:
    """SQL that writes accented Latin letters as letter and combining mark."""
    for code in range(0xC0, 0x180):
        letter, parts = chr(code), unicodedata.normalize("NFKD", chr(code))
        if parts != letter:
            expression = f"replace({expression}, '{letter}', '{parts.replace(chr(39), chr(39) * 2)}')"
    return expression


def _slug(expression: str) -> str:
    return rf"trim(regexp_replace(lower({expression}), '[^\p{{L}}\p{{N}}_]+', '-', 'g'), '-')"


@query(f"""
    SELECT page_id, CASE WHEN slug = '' THEN 'article' ELSE slug END AS slug
    FROM (SELECT page_id, {_slug(_decomposed("regexp_extract(html, '<title>(.*?)</title>', 1)"))} AS slug FROM pages)""")
def title_slugs(spark, sf):
    title = F.regexp_extract("html", r"<title>(.*?)</title>", 1)
    return t.read(spark, sf, "pages").select("page_id", text.slugify(title).alias("slug"))


@query(f"""
    WITH s AS (SELECT id, url, source_name || '-' || {_slug("title || ' ' || repeat(title, CAST(id % 8 AS INTEGER))")} AS slug FROM articles),
         c AS (SELECT id, url, rtrim(substr(slug, 1, 96), CASE WHEN length(slug) > 96 THEN '-' ELSE '' END) AS slug FROM s)
    SELECT id, slug, slug || '-' || substr(sha256(url), 1, 8) AS taken_slug FROM c""")
def article_slugs(spark, sf):
    title = F.concat("title", F.lit(" "), F.expr("repeat(title, int(id % 8))"))
    slug = text.title_slug(F.col("source_name"), title)
    return t.articles(spark, sf).select("id", "url", slug.alias("slug")).select(
        "id", "slug", text.hashed_slug(F.col("slug"), F.col("url")).alias("taken_slug")
    )


@query(f"""
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN {iso("date_trunc('day', ts)")} WHEN 5 THEN NULL ELSE {iso("ts")} END AS parsed
    FROM events""")
def parse_times(spark, sf):
    at = t.ts("ts")

    def shown(pattern, hours=0):
        return F.date_format(at + F.make_dt_interval(hours=F.lit(hours)), pattern)

    forms = F.array(
        shown("yyyy-MM-dd"),
        shown("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        shown("yyyy-MM-dd HH:mm:ss'+08:00'", 8),
        shown("EEE, dd MMM yyyy HH:mm:ss 'GMT'"),
        shown("d MMM yy HH:mm:ss '-0500'", -5),
        F.lit("some day"),
    )
    value = F.element_at(forms, (F.col("event_id") % 6 + 1).cast("int"))
    return t.read(spark, sf, "events").select("event_id", times.iso_z(times.parse_datetime(value)).alias("parsed"))


@query("""
    SELECT event_id, event_id % 7 = 0 OR (ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-21') AS inside,
           event_id % 7 = 0 OR ts >= TIMESTAMP '2024-01-24' AS recent
    FROM events""")
def window_flags(spark, sf):
    at = F.when(F.col("event_id") % 7 != 0, t.ts("ts"))
    since, until = times.build_time_range("2024-01-10", "2024-01-20")
    recent, _ = times.build_time_range(since_days=7, as_of="2024-01-31T00:00:00Z")
    return t.read(spark, sf, "events").select(
        "event_id", times.in_range(at, since, until).alias("inside"), times.in_range(at, recent, None).alias("recent")
    )


@query("""
    SELECT p_partkey, lower(p_name) || ' ' || lower(p_brand) AS normalized_name,
           replace(lower(p_name) || ' ' || lower(p_brand), ' ', '-') AS slug
    FROM part""")
def tag_names(spark, sf):
    name = F.concat(F.lit(" \t"), F.upper("p_name"), F.lit("  \n "), "p_brand", F.lit("  "))
    return t.read(spark, sf, "part").select(
        "p_partkey", text.normalize_tag(name).alias("normalized_name"), text.tag_slug(name).alias("slug")
    )


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, strlen(text) <= 2000 AS fits FROM documents")
def content_sizes(spark, sf):
    size = text.content_bytes(F.col("text"))
    return t.read(spark, sf, "documents").select("doc_id", size.cast("bigint").alias("bytes"), (size <= 2000).alias("fits"))


@query("""
    SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, sha256(text) AS digest,
           CAST(length(substr(text, 1, 500)) AS BIGINT) AS cut_chars FROM documents""")
def evaluator_inputs(spark, sf):
    """The body as it is, and cut where a limit is asked for."""
    whole, cut = text.evaluator_input(F.col("text")), text.evaluator_input(F.col("text"), most_chars=500)
    return t.read(spark, sf, "documents").select(
        "doc_id", F.length(whole).cast("bigint").alias("chars"), F.sha2(whole, 256).alias("digest"),
        F.length(cut).cast("bigint").alias("cut_chars"),
    )


@query("""
    SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE '{"doc":' || doc_id || ',"source":"' || source || '"}' END AS reply
    FROM documents""")
def reply_json(spark, sf):
    body = F.to_json(F.struct(F.col("doc_id").alias("doc"), "source"))
    form = F.element_at(
        F.array(
            F.concat(F.lit("```json\n"), body, F.lit("\n```\n")),
            F.concat(F.lit(" \n"), body),
            F.concat(F.lit("```\n"), body),
            F.concat(F.lit("Sure: "), F.col("text")),
        ),
        (F.col("doc_id") % 4 + 1).cast("int"),
    )
    return t.read(spark, sf, "documents").select("doc_id", text.extract_json(form).alias("reply"))


@query("""
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || '|' || user_id ELSE '' END AS tags FROM events""")
def tag_lists(spark, sf):
    listed = F.concat(F.lit('["'), "event_type", F.lit('", " ", "'), F.col("user_id").cast("string"), F.lit('"]'))
    form = F.element_at(F.array(listed, F.col("props"), F.concat(F.lit("["), "event_type")), (F.col("event_id") % 3 + 1).cast("int"))
    return t.read(spark, sf, "events").select("event_id", text.tag_list(form).alias("tags"))


@query(f"SELECT id, {iso('COALESCE(published_at, collected_at, updated_at, created_at)')} AS item_time FROM articles")
def item_times(spark, sf):
    return t.articles(spark, sf).select("id", times.item_time().alias("item_time"))


@query("""
    WITH newest AS (SELECT * FROM evaluations e WHERE id = (SELECT MAX(id) FROM evaluations x WHERE x.article_id = e.article_id))
    SELECT a.id, trim(n.summary) || chr(10) || chr(10) || n.recommendation_reason || chr(10) || chr(10) || '原文：' || a.url AS description,
           CASE n.content_type WHEN 'technical_article' THEN '技术文章' WHEN 'engineering_case' THEN '工程实践'
             WHEN 'research_article' THEN '科研议题' WHEN 'research_reflection' THEN '科研思考'
             WHEN 'learning_path' THEN '学习路线' WHEN 'personal_reflection' THEN '个人心得'
             WHEN 'career_experience' THEN '职业经验' WHEN 'tooling_note' THEN '工具笔记' END AS label,
           'https://example.org/api/public/articles/' || a.slug AS public_url,
           strftime(a.updated_at, '%a, %d %b %Y %H:%M:%S GMT') AS changed
    FROM newest n JOIN articles a ON a.id = n.article_id""")
def public_descriptions(spark, sf):
    c = F.col
    verdicts = latest(t.evaluations(spark, sf), "article_id", "summary", "content_type", "recommendation_reason")
    rows = t.articles(spark, sf).join(verdicts, c("id") == c("article_id"))
    return rows.select(
        "id",
        publishing.description(c("summary"), c("recommendation_reason"), c("url")).alias("description"),
        publishing.content_type_label(c("content_type")).alias("label"),
        publishing.article_url("https://example.org/", c("slug")).alias("public_url"),
        times.http_date(c("updated_at")).alias("changed"),
    )


@query("""
    SELECT position, COALESCE(regexp_matches(url, '^https?://[^/]+'), false) AS is_http,
           COALESCE(regexp_matches(instance, '^https?://'), false) AS hub_is_http FROM sources WHERE has_feed""")
def url_schemes(spark, sf):
    return t.sources(spark, sf).filter("feed IS NOT NULL").select(
        "position",
        F.coalesce(urls.is_http_url(F.col("feed.url")), F.lit(False)).alias("is_http"),
        F.coalesce(urls.has_http_scheme(F.col("feed.instance")), F.lit(False)).alias("hub_is_http"),
    )


@query(r"""
    WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '<x>', 'g'),
                         '(?s)<!--.*?-->', '<x>', 'g') AS html FROM pages),
         nodes AS (SELECT page_id, list_transform(string_split_regex(html, '<[^>]*>'),
                     lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), ' ' || chr(10))) AS parts FROM bare)
    SELECT page_id, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM nodes""")
def page_texts(spark, sf):
    return t.read(spark, sf, "pages").select("page_id", markup_text("html").alias("text"))
