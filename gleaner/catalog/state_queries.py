"""State: latest rows, pending sets, upserts, folds, content, verdict-free stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.catalog import tables as t
from gleaner.catalog.oracle_tables import iso
from gleaner.catalog.registry import query
from gleaner.functions.times import build_time_range
from gleaner.operators import content, filters, folds, history, latest, pending, upsert

AS_OF = "2025-01-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


# --- latest per key --------------------------------------------------------------

@query("""
    SELECT article_id, id, status, error FROM fetches f
    WHERE id = (SELECT MAX(id) FROM fetches x WHERE x.article_id = f.article_id)""")
def latest_fetch(spark, sf):
    return latest.latest_fetch(t.fetches(spark, sf))


@query(f"""
    SELECT article_id, id, {iso('fetched_at')} AS fetched_at, content FROM fetches f
    WHERE id = (SELECT MAX(id) FROM fetches x WHERE x.article_id = f.article_id AND x.status = 'success')""")
def latest_successful_fetch(spark, sf):
    return latest.latest_successful_fetch(t.fetches(spark, sf)).select("article_id", "id", "fetched_at", "content")


@query("""
    SELECT article_id, id, decision, content_type, summary, recommendation_reason FROM evaluations e
    WHERE id = (SELECT MAX(id) FROM evaluations x WHERE x.article_id = e.article_id)""")
def latest_evaluation(spark, sf):
    return latest.latest_evaluation(t.evaluations(spark, sf))


@query("""
    SELECT article_id, id, error, attempts FROM failures e
    WHERE id = (SELECT MAX(id) FROM failures x WHERE x.article_id = e.article_id)""")
def latest_failure(spark, sf):
    return latest.latest_failure(t.failures(spark, sf))


@query("""
    SELECT article_id,
      (SELECT status FROM stage_history q WHERE q.article_id = a.article_id AND stage = 'fetch' ORDER BY id DESC LIMIT 1) AS fetch_queue_status,
      (SELECT status FROM stage_history q WHERE q.article_id = a.article_id AND stage = 'evaluate' ORDER BY id DESC LIMIT 1) AS evaluate_queue_status
    FROM (SELECT DISTINCT article_id FROM stage_history) a""")
def stage_status(spark, sf):
    return latest.stage_status(t.stage_history(spark, sf))


@query("""
    SELECT id, article_id, stage, status, CAST(recency AS INTEGER) AS recency
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY article_id ORDER BY id DESC) AS recency FROM stage_history) WHERE recency <= 10""")
def last_stage_rows(spark, sf):
    return latest.last_n(t.stage_history(spark, sf), "article_id", 10).select("id", "article_id", "stage", "status", "recency")


@query(f"""
    SELECT schedule_id, job_id, status, {iso('created_at')} AS created_at FROM job_runs r
    WHERE created_at = (SELECT MAX(created_at) FROM job_runs x WHERE x.schedule_id = r.schedule_id)""")
def latest_schedule_runs(spark, sf):
    return latest.latest_schedule_run(t.job_runs(spark, sf)).select("schedule_id", "job_id", "status", "created_at")


# --- pending ---------------------------------------------------------------------

@query("""
    SELECT id, url FROM articles a WHERE status = 'candidate' AND retry_count < 3
      AND NOT EXISTS (SELECT 1 FROM fetches f WHERE f.article_id = a.id AND f.status = 'success')""")
def ready_for_fetch(spark, sf):
    return pending.ready_for_fetch(t.articles(spark, sf), t.fetches(spark, sf)).select("id", "url")


@query("""
    SELECT id, url FROM articles a WHERE status = 'candidate'
      AND EXISTS (SELECT 1 FROM fetches f WHERE f.article_id = a.id AND f.status = 'success')
      AND NOT EXISTS (SELECT 1 FROM evaluations e WHERE e.article_id = a.id)""")
def ready_for_evaluation(spark, sf):
    return pending.ready_for_evaluation(
        t.articles(spark, sf), t.fetches(spark, sf), t.evaluations(spark, sf)
    ).select("id", "url")


@query("""
    SELECT q.id AS queue_id, q.stage AS queue_stage, a.id, a.title FROM stage_history q JOIN articles a ON a.id = q.article_id
    WHERE q.stage = 'fetch' AND q.status = 'queued'""")
def queued_items(spark, sf):
    return pending.queued_items(t.stage_history(spark, sf), t.articles(spark, sf), "fetch").select(
        "queue_id", "queue_stage", "id", "title"
    )


@query("""
    SELECT q.id AS queue_id, a.id FROM stage_history q JOIN articles a ON a.id = q.article_id
    WHERE q.stage = 'evaluate' AND q.status = 'queued' ORDER BY q.id LIMIT 25""")
def next_queued_items(spark, sf):
    return pending.queued_items(t.stage_history(spark, sf), t.articles(spark, sf), "evaluate", limit=25).select("queue_id", "id")


@query(f"""
    WITH requests AS (SELECT user_id AS article_id, CASE WHEN event_type IN ('view', 'click') THEN 'fetch' ELSE 'evaluate' END AS stage,
                             event_id AS ordinal, ts FROM events)
    SELECT article_id, stage, MIN(ordinal) AS ordinal, {iso("arg_min(ts, ordinal)")} AS range_since, 'queued' AS status FROM requests r
    WHERE NOT EXISTS (SELECT 1 FROM stage_history q WHERE q.article_id = r.article_id AND q.stage = r.stage
                        AND q.status IN ('queued', 'running'))
    GROUP BY article_id, stage""")
def enqueue_stages(spark, sf):
    requests = t.read(spark, sf, "events").select(
        F.col("user_id").alias("article_id"),
        F.when(F.col("event_type").isin("view", "click"), "fetch").otherwise("evaluate").alias("stage"),
        F.col("event_id").alias("ordinal"),
        t.ts("ts").alias("range_since"),
        F.lit(None).cast("timestamp").alias("range_until"),
    )
    return pending.enqueue(requests, t.stage_history(spark, sf)).drop("range_until")


@query("""
    WITH seen AS (SELECT user_id AS article_id, MIN(event_id) AS ordinal FROM events GROUP BY user_id)
    SELECT article_id, ordinal FROM seen s
    WHERE EXISTS (SELECT 1 FROM articles a WHERE a.id = s.article_id AND a.status = 'candidate')
      AND NOT EXISTS (SELECT 1 FROM fetches f WHERE f.article_id = s.article_id AND f.status = 'success')
      AND NOT EXISTS (SELECT 1 FROM stage_history q WHERE q.article_id = s.article_id AND q.stage = 'fetch'
                        AND q.status IN ('queued', 'running'))""")
def fetch_requests(spark, sf):
    none = F.lit(None).cast("timestamp")
    seen = t.read(spark, sf, "events").select(
        F.col("user_id").alias("article_id"), F.col("event_id").alias("ordinal"), none.alias("range_since"),
        none.alias("range_until"),
    )
    return pending.fetch_requests(seen, t.articles(spark, sf), t.fetches(spark, sf), t.stage_history(spark, sf)).select("article_id", "ordinal")


@query("SELECT id, title, status FROM articles WHERE id IN (SELECT user_id FROM events WHERE event_type = 'error')")
def articles_by_ids(spark, sf):
    ids = t.read(spark, sf, "events").filter("event_type = 'error'").select(F.col("user_id").alias("id")).distinct()
    return pending.by_ids(t.articles(spark, sf), ids).select("id", "title", "status")


@query("SELECT id, slug FROM articles WHERE normalized_url IN (SELECT 'https://example.com/src0/' || event_id FROM events)")
def articles_by_url(spark, sf):
    keys = t.read(spark, sf, "events").select(
        F.concat(F.lit("https://example.com/src0/"), F.col("event_id").cast("string")).alias("normalized_url")
    )
    return pending.lookup(t.articles(spark, sf), "normalized_url", keys).select("id", "slug")


@query("SELECT job_id, kind, status FROM job_runs WHERE job_id = 'job-17'")
def job_run_by_id(spark, sf):
    return pending.lookup(t.job_runs(spark, sf), "job_id", "job-17").select("job_id", "kind", "status")


# --- upsert ----------------------------------------------------------------------

_BATCH = """
    batch AS (SELECT normalized_url, page_id, page_id * 3 AS ordinal,
                TIMESTAMP '2024-03-01' + to_days(CAST(page_id % 60 AS INTEGER)) AS published_at, 'size ' || length(html) AS source_content,
                CASE WHEN page_id % 3 = 0 THEN 'src0' ELSE 'src' || (page_id % 5) END AS source_name,
                CASE WHEN page_id % 3 = 0 THEN 'Weekly notes' ELSE 'Page ' || page_id END AS title,
                CASE WHEN page_id % 3 = 0 THEN 'src0-weekly-notes' ELSE 'src' || (page_id % 5) || '-page-' || page_id END AS base
              FROM (SELECT url AS normalized_url, page_id, html FROM pages) p)"""


@query(f"""
    WITH {_BATCH}
    SELECT normalized_url, ordinal, title, source_name, 't0' AS source_tags, {iso('published_at')} AS published_at, source_content FROM batch""")
def folded_batch(spark, sf):
    return upsert.fold_batch(t.sightings(spark, sf)).select(
        "normalized_url", "ordinal", "title", "source_name", "source_tags", "published_at", "source_content"
    )


@query(f"""
    WITH {_BATCH},
         fresh AS (SELECT * FROM batch b WHERE NOT EXISTS (SELECT 1 FROM known_pages k WHERE k.normalized_url = b.normalized_url))
    SELECT id, source_name, title, normalized_url, slug, status,
           {iso("published_at")} AS published_at, {iso("updated_at")} AS updated_at, source_tags, source_content
    FROM (SELECT k.id, k.source_name, k.title, k.normalized_url, k.slug, k.status, COALESCE(k.published_at, b.published_at) AS published_at,
                 CASE WHEN k.published_at IS NULL OR k.source_content IS NULL THEN TIMESTAMP '{AS_OF}' ELSE k.updated_at END AS updated_at,
                 k.source_tags, COALESCE(k.source_content, b.source_content) AS source_content
          FROM known_pages k JOIN batch b USING (normalized_url)
          UNION ALL
          SELECT (SELECT MAX(id) FROM known_pages) + ROW_NUMBER() OVER (ORDER BY ordinal), source_name, title, normalized_url,
                 CASE WHEN ordinal = MIN(ordinal) OVER (PARTITION BY base) AND base NOT IN (SELECT slug FROM known_pages) THEN base
                      ELSE base || '-' || substr(sha256(normalized_url), 1, 8) END,
                 'candidate', published_at, TIMESTAMP '{AS_OF}', 't0', source_content FROM fresh)""")
def candidate_upsert(spark, sf):
    merged = upsert.upsert_candidates(t.known_pages(spark, sf), t.sightings(spark, sf), as_of())
    return merged.select(
        "id", "source_name", "title", "normalized_url", "slug", "status", "published_at", "updated_at", "source_tags",
        "source_content",
    )


@query("""
    SELECT id, CASE WHEN EXISTS (SELECT 1 FROM articles b WHERE b.source_name = a.source_name AND b.title = a.title AND b.id < a.id)
                    THEN source_name || '/' || title || '#duplicate-' || id ELSE source_name || '/' || title END AS normalized_url
    FROM articles a""")
def duplicate_repair(spark, sf):
    coarse = t.articles(spark, sf).withColumn("normalized_url", F.concat("source_name", F.lit("/"), "title"))
    return upsert.repair_duplicates(coarse.select("id", "normalized_url"))


@query("""
    SELECT id, CASE WHEN id % 5 IN (0, 1) THEN 'candidate' WHEN id % 5 = 2 THEN 'accepted' ELSE 'rejected' END AS status FROM articles""")
def status_remap(spark, sf):
    legacy = t.articles(spark, sf).select(
        "id", t.pick(["failed", "duplicate", "accepted", "rejected", "rejected"], F.col("id") % 5).alias("status")
    )
    return upsert.remap_legacy_status(legacy)


@query("""
    WITH s AS (SELECT *, COALESCE(published_at < TIMESTAMP '2024-03-20', false) AS outside FROM sightings),
         u AS (SELECT normalized_url, COUNT(*) AS n, COUNT(*) FILTER (WHERE outside) AS o FROM s GROUP BY normalized_url),
         j AS (SELECT u.*, k.id, k.status FROM u LEFT JOIN known_pages k USING (normalized_url))
    SELECT CAST(SUM(n) AS BIGINT) AS found, COUNT(*) FILTER (WHERE id IS NULL AND n > o) AS inserted,
           COUNT(*) FILTER (WHERE n > o AND (id IS NULL OR (status = 'candidate'
              AND id NOT IN (SELECT article_id FROM fetches WHERE status = 'success')
              AND id NOT IN (SELECT article_id FROM stage_history WHERE stage = 'fetch' AND status IN ('queued', 'running'))))) AS queued_fetch,
           CAST(SUM(n) AS BIGINT) - COUNT(*) FILTER (WHERE id IS NULL AND n > o) AS skipped,
           CAST(SUM(o) AS BIGINT) AS out_of_range,
           (SELECT COUNT(*) FROM sources WHERE k % 4 = 1) AS sources_failed, (SELECT COUNT(*) FROM sources WHERE k % 4 = 2) AS sources_not_modified
    FROM j""")
def discovery_counters(spark, sf):
    since, until = build_time_range("2024-03-20")
    entries = filters.with_window_flag(t.sightings(spark, sf), since, until)
    states = t.read(spark, sf, "supplier").select(
        t.pick(["success", "failed", "not_modified", "success"], F.col("s_suppkey") % 4).alias("last_status")
    )
    return upsert.discovery_counters(
        entries, t.known_pages(spark, sf), t.fetches(spark, sf), t.stage_history(spark, sf), states
    )


# --- folds -----------------------------------------------------------------------

_FOLD = """
    fold AS (SELECT a.*,
        (SELECT COUNT(*) FROM fetches f WHERE f.article_id = a.id AND f.status = 'failed') AS failed,
        (SELECT decision FROM evaluations e WHERE e.article_id = a.id ORDER BY evaluated_at DESC, id DESC LIMIT 1) AS decision,
        (SELECT MAX(evaluated_at) FROM evaluations e WHERE e.article_id = a.id AND decision = 'accept') AS accepted_at,
        (SELECT f.published_at FROM fetches f WHERE f.article_id = a.id AND f.published_at IS NOT NULL ORDER BY fetched_at, id LIMIT 1) AS found,
        (SELECT MAX(moment) FROM (SELECT fetched_at AS moment FROM fetches f WHERE f.article_id = a.id
                              UNION ALL SELECT evaluated_at FROM evaluations e WHERE e.article_id = a.id)) AS last_at,
        (SELECT [COALESCE(error, '')] FROM (SELECT error, fetched_at AS moment, 0 AS rank, id FROM fetches f WHERE f.article_id = a.id
                              UNION ALL SELECT NULL, evaluated_at, 2, id FROM evaluations e WHERE e.article_id = a.id)
           ORDER BY moment DESC, rank DESC, id DESC LIMIT 1) AS last_error
      FROM articles a)"""


@query(f"""
    WITH {_FOLD}
    SELECT id, CASE decision WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' WHEN 'low_confidence' THEN 'low_confidence'
                    ELSE status END AS status,
           CAST(retry_count + failed AS INTEGER) AS retry_count, {iso("COALESCE(published_at, found)")} AS published_at,
           {iso("COALESCE(accepted_at, collected_at)")} AS collected_at, {iso("COALESCE(last_at, updated_at)")} AS updated_at,
           CASE WHEN last_error IS NULL THEN error ELSE NULLIF(last_error[1], '') END AS error
    FROM fold""")
def state_fold(spark, sf):
    folded = folds.fold_state(t.articles(spark, sf), t.fetches(spark, sf), t.evaluations(spark, sf))
    return folded.select("id", "status", "retry_count", "published_at", "collected_at", "updated_at", "error")


@query(f"""
    WITH changes AS (
            SELECT article_id, NULL AS status, CASE WHEN status = 'failed' THEN error END AS error, fetched_at AS moment, 0 AS rank, id FROM fetches
            UNION ALL SELECT article_id, CASE decision WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' ELSE decision END, NULL,
                   evaluated_at, 2, id FROM evaluations
            UNION ALL SELECT o_orderkey, 'candidate', NULL, o_orderdate + INTERVAL 90 DAY, 3, o_orderkey FROM orders),
         last AS (SELECT article_id, arg_max(status, ROW(moment, rank, id)) FILTER (WHERE status IS NOT NULL) AS status, MAX(moment) AS moment,
                         arg_max([error], ROW(moment, rank, id)) FILTER (WHERE rank < 3) AS error FROM changes GROUP BY article_id)
    SELECT a.id, COALESCE(l.status, a.status) AS status, {iso("COALESCE(l.moment, a.updated_at)")} AS updated_at,
           CASE WHEN l.error IS NULL THEN a.error ELSE l.error[1] END AS error
    FROM articles a LEFT JOIN last l ON l.article_id = a.id""")
def override_fold(spark, sf):
    overrides = t.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("article_id"), F.lit("candidate").alias("status"),
        (t.ts("o_orderdate") + t.days(90)).alias("changed_at"),
    )
    folded = folds.fold_state(t.articles(spark, sf), t.fetches(spark, sf), t.evaluations(spark, sf), overrides)
    return folded.select("id", "status", "updated_at", "error")


# --- past moments ----------------------------------------------------------------

_QUARTERS = [f"{year}-{month:02}-01" for year in range(1992, 2000) for month in (1, 4, 7, 10)]


@query(f"""
    WITH days AS (SELECT TIMESTAMP '1992-01-01' + to_months(CAST(3 * i AS INTEGER)) AS day FROM range({len(_QUARTERS)}) r(i)),
         seen AS (SELECT day, article_id, MAX(id) AS id FROM days JOIN fetches ON fetched_at <= day GROUP BY day, article_id)
    SELECT {iso("day")} AS moment, status, COUNT(*) AS n FROM seen JOIN fetches USING (id) GROUP BY day, status""")
def fetch_status_by_quarter(spark, sf):
    """How the latest fetches stood at the beginning of every quarter."""
    spans = history.intervals(t.fetches(spark, sf), "article_id", "fetched_at", "status")
    moments = [F.lit(day).cast("timestamp") for day in _QUARTERS]
    return history.at_moments(spans, moments).groupBy("moment", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH seen AS (SELECT f.id AS fetch_id, f.article_id, MAX(e.id) AS id FROM fetches f JOIN evaluations e
                  ON e.article_id = f.article_id AND e.evaluated_at <= f.fetched_at GROUP BY f.id, f.article_id)
    SELECT fetch_id, s.article_id, s.id AS evaluation_id, decision FROM seen s JOIN evaluations e ON e.id = s.id""")
def verdicts_at_fetch(spark, sf):
    """The verdict that stood when an article was fetched again."""
    spans = history.intervals(t.evaluations(spark, sf), "article_id", "evaluated_at", "decision")
    asked = t.fetches(spark, sf).select(F.col("id").alias("fetch_id"), "article_id", "fetched_at")
    found = history.joined_as_of(asked, spans, "article_id", "fetched_at", "year")
    return found.select("fetch_id", "article_id", F.col("id").alias("evaluation_id"), "decision")


# --- content ---------------------------------------------------------------------

def _to_fetch(spark, sf):
    """Articles from documents: feed content, none, or blank; page content of varying size."""
    k = F.col("doc_id")
    docs = t.read(spark, sf, "documents").select("doc_id", "text")
    at = F.lit("2024-01-01").cast("timestamp") + t.days((k % 90).cast("int"))
    url = F.concat(F.lit("https://example.com/"), k.cast("string"))
    articles = docs.select(
        k.alias("id"), url.alias("url"),
        F.when(k % 2 == 0, F.col("text")).when(k % 3 == 0, F.lit(" ")).alias("source_content"),
        F.lit(None).cast("map<string,string>").alias("source_content_metadata"),
        F.when(k % 5 == 0, at).alias("published_at"),
    )
    pages = docs.filter(k % 7 != 0).select(
        url.alias("url"), F.when(k % 11 != 0, F.reverse("text")).otherwise(F.lit("  ")).alias("content"),
        at.alias("published_at"), F.when(k % 17 == 0, F.lit("timeout")).alias("fetch_error"),
    )
    return articles, pages


_TRIMMED = "trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
_CONTENT = f"""
    facts AS (SELECT doc_id, doc_id % 2 = 0 AND strlen({_TRIMMED.format('text')}) <= 3000 AND {_TRIMMED.format('text')} <> '' AS own, text,
                CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 <> 0 THEN NULLIF({_TRIMMED.format('reverse(text)')}, '') END AS page,
                CASE WHEN doc_id % 7 <> 0 AND doc_id % 17 = 0 THEN 'timeout' END AS fetch_error,
                TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 90 AS INTEGER)) AS moment FROM documents),
    outcome AS (SELECT *, CASE WHEN own THEN NULL WHEN fetch_error IS NOT NULL THEN fetch_error WHEN page IS NULL THEN 'empty markdown'
                WHEN strlen(page) > 3000 THEN 'markdown too large: ' || strlen(page) || ' > 3000' END AS error FROM facts),
    chosen AS (SELECT *, CASE WHEN error IS NULL THEN CASE WHEN own THEN CASE WHEN doc_id % 5 = 0 THEN moment END
                         WHEN doc_id % 7 <> 0 THEN moment END END AS new_published_at FROM outcome)"""


@query(f"""
    WITH {_CONTENT}
    SELECT doc_id AS article_id, CASE WHEN error IS NULL THEN 'success' ELSE 'failed' END AS status, error,
           CASE WHEN error IS NULL THEN sha256(CASE WHEN own THEN {_TRIMMED.format('text')} ELSE page END) END AS digest,
           CASE WHEN error IS NULL AND own THEN 'feed-entry' END AS crawler, {iso('new_published_at')} AS published_at
    FROM chosen""")
def content_choice(spark, sf):
    outcomes = content.choose_content(*_to_fetch(spark, sf), max_bytes=3000)
    return outcomes.select(
        "article_id", "status", "error", F.sha2("content", 256).alias("digest"),
        F.try_element_at("metadata", F.lit("crawler")).alias("crawler"), "published_at",
    )


_CHECKED = _CONTENT + """,
    checked AS (SELECT doc_id, CASE WHEN error IS NOT NULL THEN 'failed'
                  WHEN COALESCE(CASE WHEN doc_id % 5 = 0 THEN moment END, new_published_at) < TIMESTAMP '2024-02-01' THEN 'skipped_out_of_range'
                  ELSE 'succeeded' END AS stage_status FROM chosen)"""


def _checked(spark, sf):
    articles, pages = _to_fetch(spark, sf)
    since, until = build_time_range("2024-02-01")
    return content.recheck_window(content.choose_content(articles, pages, max_bytes=3000), articles, since, until)


@query(f"""
    WITH {_CHECKED}
    SELECT doc_id AS article_id, stage_status, CASE WHEN stage_status = 'succeeded' THEN 'evaluate' END AS next_stage FROM checked""")
def window_recheck(spark, sf):
    return _checked(spark, sf).select("article_id", "stage_status", "next_stage")


@query(f"""
    WITH {_CHECKED}
    SELECT COUNT(*) AS attempted, COUNT(*) FILTER (WHERE stage_status = 'succeeded') AS succeeded,
           COUNT(*) FILTER (WHERE stage_status = 'failed') AS failed, COUNT(*) FILTER (WHERE stage_status = 'skipped_out_of_range') AS skipped,
           COUNT(*) FILTER (WHERE stage_status = 'succeeded' AND doc_id NOT IN
              (SELECT article_id FROM stage_history WHERE stage = 'evaluate' AND status IN ('queued', 'running'))) AS queued_evaluate
    FROM checked""")
def fetch_counters(spark, sf):
    active = t.stage_history(spark, sf).filter("stage = 'evaluate' AND status IN ('queued', 'running')")
    return content.fetch_counters(_checked(spark, sf), active)
