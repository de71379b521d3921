"""Listings, reports, publishing and the feed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.catalog import tables as t
from gleaner.catalog.oracle_tables import iso
from gleaner.catalog.registry import query
from gleaner.functions.times import item_time
from gleaner.operators import filters
from gleaner.plans import listings, paging, publishing, reports, search
from gleaner.session import shared_folder

BASE_URL = "https://example.org"
_ITEM_TIME = "COALESCE(a.published_at, a.collected_at, a.updated_at, a.created_at)"
_TAGS = """(SELECT string_agg(v.name, '|' ORDER BY lower(v.name), v.name) FROM links l JOIN vocabulary v ON v.id = l.tag_id
            WHERE l.article_id = a.id AND v.status = 'active')"""


def _last(log: str, field: str, where: str = "") -> str:
    return f"(SELECT {field} FROM {log} x WHERE x.article_id = a.id {where} ORDER BY x.id DESC LIMIT 1)"


def _state(spark, sf):
    return t.fetches(spark, sf), t.evaluations(spark, sf), t.failures(spark, sf)


# --- filters ---------------------------------------------------------------------

@query("SELECT id, status FROM articles WHERE status <> 'accepted'")
def listing_unaccepted(spark, sf):
    return filters.by_status(t.articles(spark, sf), "unaccepted").select("id", "status")


@query("SELECT id FROM articles WHERE source_name = 'src0' AND status = 'rejected'")
def listing_by_source(spark, sf):
    return listings.article_filter(t.articles(spark, sf), status="rejected", source="src0").select("id")


@query("SELECT id, title FROM articles WHERE title ILIKE '%h_gh%' OR url ILIKE '%h_gh%' OR source_name ILIKE '%h_gh%'")
def listing_search(spark, sf):
    return listings.article_filter(t.articles(spark, sf), status="all", q=" H_gh ").select("id", "title")


@query("SELECT id, title FROM articles WHERE title ILIKE '%r_ent 4%' OR url ILIKE '%r_ent 4%' OR source_name ILIKE '%r_ent 4%'")
def indexed_search(spark, sf):
    """The same by the index of trigrams."""
    folder = shared_folder(spark, "search-index")
    search.build_index(t.articles(spark, sf), folder)
    return search.search(spark, folder, " R_ent 4").select("id", "title")


@query("SELECT id FROM articles WHERE published_at >= TIMESTAMP '1996-01-01' AND published_at < TIMESTAMP '1997-01-01'")
def listing_published_between(spark, sf):
    return listings.article_filter(t.articles(spark, sf), since="1996-01-01", until="1996-12-31").select("id")


_FAILED = f"""({_last('fetches', 'status')} = 'failed'
      OR (NOT EXISTS (SELECT 1 FROM evaluations e WHERE e.article_id = a.id) AND EXISTS (SELECT 1 FROM failures f WHERE f.article_id = a.id)))"""


@query(f"SELECT id, status FROM articles a WHERE {_FAILED}")
def failed_articles(spark, sf):
    return filters.failed_only(t.articles(spark, sf), *_state(spark, sf)).select("id", "status")


@query(f"SELECT COUNT(*) AS total FROM articles a WHERE status = 'candidate' AND title ILIKE '%urgent%' AND {_FAILED}")
def filtered_total(spark, sf):
    rows = listings.article_filter(t.articles(spark, sf), status="candidate", q="urgent", logs=_state(spark, sf))
    return rows.agg(F.count(F.lit(1)).alias("total"))


# --- listings --------------------------------------------------------------------

_PAGE = f"""
    SELECT a.id, a.title, a.url, a.source_name, a.status, a.retry_count, {iso('a.published_at')} AS published_at,
           {iso('a.created_at')} AS created_at, {iso('a.updated_at')} AS updated_at, {iso('a.collected_at')} AS collected_at,
           {_last('stage_history', 'status', "AND x.stage = 'fetch'")} AS fetch_queue_status,
           {_last('stage_history', 'status', "AND x.stage = 'evaluate'")} AS evaluate_queue_status,
           {_last('fetches', 'status')} AS fetch_status, {_last('fetches', 'error')} AS fetch_error,
           {_last('evaluations', 'decision')} AS evaluation_status, {_last('failures', 'error')} AS evaluation_error
    FROM (SELECT * FROM articles a WHERE {{where}} ORDER BY {{order}} LIMIT {{limit}} OFFSET {{offset}}) a"""


@query(_PAGE.format(where="true", order="a.updated_at DESC, a.id DESC", limit=50, offset=100))
def article_page(spark, sf):
    return listings.article_page(t.articles(spark, sf), *_state(spark, sf), t.stage_history(spark, sf), page=3)


@query(_PAGE.format(where=f"status <> 'accepted' AND source_name = 'src0' AND {_FAILED}",
                    order="a.published_at ASC NULLS FIRST, a.id ASC", limit=1000, offset=0))
def failed_article_page(spark, sf):
    return listings.article_page(
        t.articles(spark, sf), *_state(spark, sf), t.stage_history(spark, sf), page=0, page_size=1000,
        status="unaccepted", source="src0", failed_only=True, sort="published_at", order="ASC",
    )


@query("""
    SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY updated_at DESC, id DESC) AS ids,
           (SELECT COUNT(*) FROM articles WHERE status = 'candidate') AS total, 2 AS page, 30 AS page_size,
           60 < (SELECT COUNT(*) FROM articles WHERE status = 'candidate') AS has_next
    FROM (SELECT * FROM articles WHERE status = 'candidate' ORDER BY updated_at DESC, id DESC LIMIT 30 OFFSET 30)""")
def page_envelope(spark, sf):
    rows = listings.article_filter(t.articles(spark, sf), status="candidate")
    page = listings.paged(rows.orderBy(*listings.listing_order("unknown", "desc")), 2, 30)
    envelope = listings.page_envelope(page, rows, 2, 30)
    newest = F.array_sort(F.transform("items", lambda i: F.struct(-F.unix_timestamp(i.updated_at), -i.id, i.id)))
    ids = F.array_join(F.transform(newest, lambda i: i.id.cast("string")), ",")
    return envelope.select(ids.alias("ids"), "total", "page", "page_size", "has_next")


def _behind(rows, keys, n):
    """The cursor behind the first ``n`` rows."""
    return paging.cursor_of(paging.cursor_page(rows, keys, n), keys)


@query(f"""
    SELECT ROW_NUMBER() OVER (ORDER BY p.published_at NULLS FIRST, p.id) AS position, id, title, published_at, fetch_status, evaluation_status
    FROM ({_PAGE.format(where="true", order="a.published_at ASC NULLS FIRST, a.id ASC", limit=60, offset=500)}) p""")
def article_cursor_page(spark, sf):
    """The page after the first 500 articles by publication time, by cursor."""
    articles, keys = t.articles(spark, sf), listings.listing_keys("published_at", "asc")
    page = listings.article_page(
        articles, *_state(spark, sf), t.stage_history(spark, sf), page_size=60, sort="published_at", order="asc", cursor=_behind(articles, keys, 500)
    )
    place = F.row_number().over(Window.orderBy(*paging.ordering(keys))).cast("long")
    return page.select(place.alias("position"), "id", "title", "published_at", "fetch_status", "evaluation_status")


@query(f"""
    SELECT ROW_NUMBER() OVER (ORDER BY {_ITEM_TIME} DESC, a.id DESC) AS position, a.id, a.slug, COALESCE({_TAGS}, '') AS tags
    FROM (SELECT * FROM articles a WHERE status = 'accepted' ORDER BY {_ITEM_TIME} DESC, a.id DESC LIMIT 40 OFFSET 200) a""")
def public_cursor_page(spark, sf):
    """The page after the first 200 accepted articles, by cursor."""
    accepted = filters.by_status(t.articles(spark, sf), "accepted").withColumn("item_time", item_time())
    page = listings.public_page(
        t.articles(spark, sf), t.evaluations(spark, sf), t.links(spark, sf), t.vocabulary(spark, sf), page_size=40,
        cursor=_behind(accepted, listings.PUBLIC_KEYS, 200),
    )
    place = F.row_number().over(Window.orderBy(F.desc(item_time()), F.desc("id"))).cast("long")
    return page.select(place.alias("position"), "id", "slug", "tags")


_PUBLIC = f"""
    SELECT a.id, a.slug, a.title, a.url, a.source_name AS source, a.status, {iso('a.published_at')} AS published_at,
           {iso('a.collected_at')} AS collected_at, {iso('a.created_at')} AS created_at, {iso('a.updated_at')} AS updated_at,
           {_last('evaluations', 'summary')} AS summary, COALESCE({_TAGS}, '') AS tags,
           {_last('evaluations', 'content_type')} AS content_type, {_last('evaluations', 'recommendation_reason')} AS recommendation_reason
    FROM (SELECT * FROM articles a WHERE status = 'accepted' {{where}} {{page}}) a"""


@query(_PUBLIC.format(where="AND (title ILIKE '%low%' OR url ILIKE '%low%' OR source_name ILIKE '%low%')",
                      page=f"ORDER BY {_ITEM_TIME} DESC, a.id DESC LIMIT 40 OFFSET 40"))
def public_page(spark, sf):
    return listings.public_page(
        t.articles(spark, sf), t.evaluations(spark, sf), t.links(spark, sf), t.vocabulary(spark, sf), page=2, page_size=40, q="low"
    )


@query(_PUBLIC.format(where="", page=""))
def public_index(spark, sf):
    return listings.public_index(t.articles(spark, sf), t.evaluations(spark, sf), t.links(spark, sf), t.vocabulary(spark, sf))


@query(f"""
    SELECT a.id, a.slug, a.retry_count, {_last('fetches', 'content', "AND x.status = 'success'")} AS content,
           {_last('fetches', iso('fetched_at'), "AND x.status = 'success'")} AS fetched_at,
           {_last('evaluations', 'summary')} AS summary, {_last('evaluations', 'content_type')} AS content_type, COALESCE({_TAGS}, '') AS tags
    FROM articles a WHERE status = 'accepted' AND slug IN (SELECT 'src0-' || event_id FROM events)""")
def public_details(spark, sf):
    slugs = t.read(spark, sf, "events").select(F.concat(F.lit("src0-"), F.col("event_id").cast("string")).alias("slug"))
    rows = listings.public_detail(
        t.articles(spark, sf), t.fetches(spark, sf), t.evaluations(spark, sf), t.links(spark, sf), t.vocabulary(spark, sf), slugs
    )
    return rows.select("id", "slug", "retry_count", "content", "fetched_at", "summary", "content_type", "tags")


@query(f"""
    SELECT a.id AS article_id, a.title, {_last('fetches', 'id')} AS fetch_id, {_last('fetches', 'status')} AS fetch_status,
           {_last('evaluations', 'id')} AS evaluation_id, {_last('evaluations', 'decision')} AS decision, {_last('failures', 'error')} AS failure,
           COALESCE((SELECT string_agg(CAST(id AS VARCHAR), '|' ORDER BY id DESC) FROM
              (SELECT id FROM stage_history q WHERE q.article_id = a.id ORDER BY id DESC LIMIT 10)), '') AS queue
    FROM articles a""")
def article_details(spark, sf):
    rows = listings.article_detail(t.articles(spark, sf), *_state(spark, sf), t.stage_history(spark, sf))
    return rows.select(
        "article_id", "article.title",
        F.col("latest_fetch.id").alias("fetch_id"), F.col("latest_fetch.status").alias("fetch_status"),
        F.col("latest_evaluation.id").alias("evaluation_id"), F.col("latest_evaluation.decision").alias("decision"),
        F.col("latest_evaluation_failure.error").alias("failure"),
        F.transform("queue", lambda q: q.id.cast("string")).alias("queue"),
    )


# --- reports ---------------------------------------------------------------------

@query("""
    SELECT s.status, COUNT(a.id) AS n FROM (VALUES ('candidate'), ('accepted'), ('rejected'), ('low_confidence'), ('skipped_out_of_range')) AS s(status)
    LEFT JOIN articles a ON a.status = s.status GROUP BY s.status""")
def status_counts(spark, sf):
    return reports.status_counts(t.articles(spark, sf))


@query("""
    SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'candidate') AS candidate, COUNT(*) FILTER (WHERE status = 'accepted') AS accepted,
           COUNT(*) FILTER (WHERE status = 'rejected') AS rejected, COUNT(*) FILTER (WHERE status = 'low_confidence') AS low_confidence,
           COUNT(*) FILTER (WHERE status = 'skipped_out_of_range') AS skipped_out_of_range,
           (SELECT COUNT(*) FROM fetches f WHERE status = 'failed' AND id = (SELECT MAX(id) FROM fetches x WHERE x.article_id = f.article_id)) AS fetch_failed,
           (SELECT COUNT(*) FROM failures f WHERE NOT EXISTS (SELECT 1 FROM evaluations e WHERE e.article_id = f.article_id)
               AND id = (SELECT MAX(id) FROM failures x WHERE x.article_id = f.article_id)) AS evaluation_failed
    FROM articles""")
def summary(spark, sf):
    return reports.summary(t.articles(spark, sf), *_state(spark, sf))


@query("SELECT article_id, error FROM fetches f WHERE status = 'failed' AND id = (SELECT MAX(id) FROM fetches x WHERE x.article_id = f.article_id)")
def fetch_failed(spark, sf):
    return reports.fetch_failed_ids(t.fetches(spark, sf))


@query("""
    SELECT article_id, error FROM failures f WHERE NOT EXISTS (SELECT 1 FROM evaluations e WHERE e.article_id = f.article_id)
      AND id = (SELECT MAX(id) FROM failures x WHERE x.article_id = f.article_id)""")
def evaluation_failed(spark, sf):
    return reports.evaluation_failed_ids(t.evaluations(spark, sf), t.failures(spark, sf))


@query("SELECT DISTINCT source_name FROM articles")
def source_names(spark, sf):
    return reports.source_names(t.articles(spark, sf))


@query(f"""
    SELECT job_id, kind, status, {iso('created_at')} AS created_at, CAST(epoch(finished_at) - epoch(started_at) AS BIGINT) AS seconds
    FROM job_runs ORDER BY job_runs.created_at DESC, job_id DESC LIMIT 100""")
def run_history(spark, sf):
    return reports.run_history(t.job_runs(spark, sf)).select("job_id", "kind", "status", "created_at", "seconds")


@query("""
    SELECT a.id AS article_id, a.title, a.url, 'fetch' AS stage, f.error FROM fetches f JOIN articles a ON a.id = f.article_id
    WHERE f.status = 'failed' AND f.id = (SELECT MAX(id) FROM fetches x WHERE x.article_id = f.article_id)
    UNION ALL
    SELECT a.id, a.title, a.url, 'evaluation', f.error FROM failures f JOIN articles a ON a.id = f.article_id
    WHERE NOT EXISTS (SELECT 1 FROM evaluations e WHERE e.article_id = f.article_id)
      AND f.id = (SELECT MAX(id) FROM failures x WHERE x.article_id = f.article_id)""")
def failure_report(spark, sf):
    return reports.failure_report(t.articles(spark, sf), *_state(spark, sf))


@query("""
    WITH report AS (
        SELECT a.id AS article_id, a.title, a.url, 'fetch' AS stage, f.error FROM fetches f JOIN articles a ON a.id = f.article_id
        WHERE f.status = 'failed' AND f.id = (SELECT MAX(id) FROM fetches x WHERE x.article_id = f.article_id)
        UNION ALL
        SELECT a.id, a.title, a.url, 'evaluation', f.error FROM failures f JOIN articles a ON a.id = f.article_id
        WHERE NOT EXISTS (SELECT 1 FROM evaluations e WHERE e.article_id = f.article_id)
          AND f.id = (SELECT MAX(id) FROM failures x WHERE x.article_id = f.article_id)),
    page AS (SELECT * FROM report ORDER BY article_id, stage LIMIT 50 OFFSET 100)
    SELECT ROW_NUMBER() OVER (ORDER BY article_id, stage) AS position, *, (SELECT COUNT(*) FROM report) AS total FROM page""")
def failure_report_page(spark, sf):
    """The page after the first 100 standing failures, with the total."""
    failed = reports.standing_failures(*_state(spark, sf))
    page = reports.failure_report_page(t.articles(spark, sf), *_state(spark, sf), 50, _behind(failed, reports.FAILURE_KEYS, 100))
    return page.select("total", F.posexplode("items").alias("at", "item")).select((F.col("at") + 1).cast("long").alias("position"), "item.*", "total")


# --- publishing ------------------------------------------------------------------

_PUBLISHED = f"""
    SELECT a.*, f.content, f.fetched_at, e.summary, e.content_type, e.recommendation_reason, COALESCE({_TAGS}, '') AS tags
    FROM articles a JOIN fetches f ON f.article_id = a.id JOIN evaluations e ON e.article_id = a.id
    WHERE a.status = 'accepted' AND f.id = (SELECT MAX(id) FROM fetches x WHERE x.article_id = a.id AND x.status = 'success')
      AND e.id = (SELECT MAX(id) FROM evaluations x WHERE x.article_id = a.id)"""


def _publishable(spark, sf):
    return publishing.publishable(
        t.articles(spark, sf), t.fetches(spark, sf), t.evaluations(spark, sf), t.links(spark, sf), t.vocabulary(spark, sf)
    )


@query(f"""
    WITH p AS ({_PUBLISHED})
    SELECT slug, title, url, source_name AS source, {iso('published_at')} AS published_at, {iso('collected_at')} AS collected_at,
           content_type, summary, tags, recommendation_reason, 'articles/' || slug || '.md' AS markdown_path FROM p""")
def published_index(spark, sf):
    return publishing.public_records(publishing.newest_first(_publishable(spark, sf)))


@query(f"""
    WITH p AS ({_PUBLISHED})
    SELECT slug, '---' || chr(10) || 'title: "' || title || '"' || chr(10) || 'url: "' || url || '"' || chr(10)
        || 'source: "' || source_name || '"' || chr(10) || 'content_type: "' || content_type || '"' || chr(10)
        || 'published_at: "' || COALESCE({iso('published_at')}, '') || '"' || chr(10)
        || 'collected_at: "' || COALESCE({iso('collected_at')}, '') || '"' || chr(10) || 'tags:' || chr(10)
        || CASE WHEN tags = '' THEN '' ELSE '  - "' || replace(tags, '|', '"' || chr(10) || '  - "') || '"' END || chr(10) || '---' || chr(10) || chr(10)
        || '> 来源信息' || chr(10) || '>' || chr(10) || '> - 来源：' || source_name || chr(10) || '> - 原文：' || url || chr(10)
        || '> - 原文时间：' || COALESCE({iso('published_at')}, '未知') || chr(10) || '> - 抓取时间：' || {iso('fetched_at')} || chr(10) || chr(10)
        || trim(content, ' ' || chr(10)) || chr(10) AS document
    FROM p""")
def published_documents(spark, sf):
    return publishing.documents(_publishable(spark, sf))


@query(f"""
    WITH p AS ({_PUBLISHED})
    SELECT slug, title, {iso('published_at')} AS published_at, tags, 'articles/' || slug || '.md' AS markdown_path FROM p""")
def published_snapshot(spark, sf):
    """The snapshot as written: index lines read back, joined with the stored records."""
    folder = shared_folder(spark, "published")
    publishing.publish_snapshot(_publishable(spark, sf), folder)
    folder = publishing.published_version(spark, folder)
    index = spark.read.schema(
        "slug string, title string, published_at string, tags array<string>, markdown_path string"
    ).json(f"{folder}/index")
    stored = spark.read.parquet(f"{folder}/articles").select("slug", F.get_json_object("record", "$.markdown_path").alias("path"))
    return index.join(stored, "slug").filter(F.col("path") == F.col("markdown_path")).drop("path")


def _published_twice(spark, sf):
    """Publish an earlier state (some titles differ, some articles aren't accepted yet, others are no more) and then the present one."""
    folder, articles, logs = shared_folder(spark, "published-changes"), t.articles(spark, sf), t.fetches(spark, sf)
    rest = logs, t.evaluations(spark, sf), t.links(spark, sf), t.vocabulary(spark, sf)
    k = F.col("id")
    earlier = articles.withColumns({
        "title": F.when(k % 50 == 0, F.concat("title", F.lit(" (draft)"))).otherwise(F.col("title")),
        "slug": F.when(k % 40 == 1, F.concat(F.lit("was-"), "slug")).otherwise(F.col("slug")),
        "status": F.when(k % 30 == 2, F.lit("candidate")).otherwise(F.col("status")),
    })
    publishing.publish_changes(publishing.publishable_rows(earlier, *rest), logs, folder)
    counts = publishing.publish_changes(publishing.publishable_rows(articles, *rest), logs, folder)
    return folder, counts


@query(f"""
    WITH p AS ({_PUBLISHED})
    SELECT COUNT(*) FILTER (WHERE id % 50 = 0 OR id % 40 = 1 OR id % 30 = 2) AS written,
           COUNT(*) FILTER (WHERE id % 40 = 1 AND id % 30 <> 2) AS gone,
           COUNT(*) FILTER (WHERE NOT (id % 50 = 0 OR id % 40 = 1 OR id % 30 = 2)) AS kept FROM p""")
def published_change_counts(spark, sf):
    _, counts = _published_twice(spark, sf)
    return spark.createDataFrame([tuple(counts.values())], "written long, gone long, kept long")


@query(f"WITH p AS ({_PUBLISHED}) SELECT slug, title, 'articles/' || slug || '.md' AS path, id FROM p")
def published_changes(spark, sf):
    """What stands after the second publishing: as if all had been published at once."""
    folder, _ = _published_twice(spark, sf)
    record = F.from_json("record", "title string, markdown_path string")
    return publishing.published_articles(spark, folder).filter("document IS NOT NULL").select(
        "slug", record["title"].alias("title"), record["markdown_path"].alias("path"), "id"
    )



@query(f"WITH p AS ({_PUBLISHED}) SELECT COUNT(*) AS published FROM p")
def publish_counter(spark, sf):
    return publishing.publish_counter(_publishable(spark, sf))


@query(f"""
    WITH p AS ({_PUBLISHED})
    SELECT slug FROM articles WHERE slug NOT IN (SELECT slug FROM p)""")
def stale_slugs(spark, sf):
    return publishing.stale_slugs(t.articles(spark, sf).select("slug"), _publishable(spark, sf))


# --- feed ------------------------------------------------------------------------

_ITEMS = f"""
    items AS (SELECT a.id, a.slug, a.title, a.url, a.source_name AS source, {_ITEM_TIME} AS item_time,
        {_last('evaluations', 'summary')} AS summary, {_last('evaluations', 'recommendation_reason')} AS reason,
        CASE {_last('evaluations', 'content_type')} WHEN 'technical_article' THEN '技术文章' WHEN 'engineering_case' THEN '工程实践'
             WHEN 'research_article' THEN '科研议题' WHEN 'research_reflection' THEN '科研思考'
             WHEN 'learning_path' THEN '学习路线' WHEN 'personal_reflection' THEN '个人心得'
             WHEN 'career_experience' THEN '职业经验' WHEN 'tooling_note' THEN '工具笔记' END AS label, {_TAGS} AS tags
      FROM articles a WHERE a.status = 'accepted' ORDER BY {_ITEM_TIME} DESC, a.id DESC LIMIT 50),
    shown AS (SELECT *, 'https://example.org/api/public/articles/' || slug AS link, strftime(item_time, '%a, %d %b %Y %H:%M:%S GMT') AS pub_date,
        COALESCE(trim(summary) || chr(10) || chr(10), '') || COALESCE(reason || chr(10) || chr(10), '') || '原文：' || url AS description,
        concat_ws('|', label, tags) AS categories FROM items),
    doc AS (SELECT '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<rss version="2.0"><channel><title>A &amp; B</title><link>https://example.org</link>'
        || '<description>Picked</description><language>zh-CN</language><ttl>60</ttl><lastBuildDate>'
        || strftime(MAX(item_time), '%a, %d %b %Y %H:%M:%S GMT') || '</lastBuildDate>'
        || string_agg('<item><guid isPermaLink="true">' || link || '</guid><title>' || title || '</title><link>' || link || '</link><description>'
             || description || '</description><source url="' || url || '">' || source || '</source><pubDate>' || pub_date || '</pubDate>'
             || CASE WHEN categories = '' THEN '' ELSE '<category>' || replace(categories, '|', '</category><category>') || '</category>' END
             || '</item>', '' ORDER BY item_time DESC, id DESC) || '</channel></rss>' AS document,
        strftime(MAX(item_time), '%a, %d %b %Y %H:%M:%S GMT') AS last_modified, MAX(item_time) AS latest FROM shown)"""


def _items(spark, sf):
    return publishing.feed_items(
        t.articles(spark, sf), t.evaluations(spark, sf), t.links(spark, sf), t.vocabulary(spark, sf), BASE_URL
    )


def _feed(spark, sf):
    return publishing.feed_document(_items(spark, sf), "A & B", BASE_URL, "Picked", ttl_minutes=60)


@query(f"WITH {_ITEMS} SELECT link AS guid, title, description, source, url AS source_url, pub_date, categories FROM shown")
def feed_items(spark, sf):
    return _items(spark, sf).select("guid", "title", "description", "source", "source_url", "pub_date", "categories")


@query(f"WITH {_ITEMS} SELECT document, '\"' || sha256(document) || '\"' AS etag, last_modified FROM doc")
def feed_document(spark, sf):
    return _feed(spark, sf)


@query(f"WITH {_ITEMS} SELECT {iso('latest')} AS latest FROM doc")
def latest_item_time(spark, sf):
    return publishing.latest_item_time(_items(spark, sf))


@query(f"""
    WITH {_ITEMS}
    SELECT o_orderkey AS client, CASE o_orderkey % 3 WHEN 0 THEN false WHEN 1 THEN o_orderdate >= latest ELSE false END AS unchanged
    FROM orders, doc""")
def feed_not_modified(spark, sf):
    k = F.col("o_orderkey")
    requests = t.read(spark, sf, "orders").select(
        k.alias("client"),
        F.when(k % 3 == 0, F.lit('"other"')).when(k % 3 == 1, F.lit("")).alias("if_none_match"),
        F.when(k % 3 == 1, F.date_format(t.ts("o_orderdate"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
        .when(k % 3 == 2, F.lit("yesterday")).alias("if_modified_since"),
    )
    return publishing.not_modified(requests, _feed(spark, sf)).select("client", "unchanged")
