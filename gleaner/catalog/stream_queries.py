"""Streaming runs over files derived from the given tables.

The input is dealt into a few parts by rule.  Each is a micro-batch of as many files
as the table has tasks; the streamed result must equal the batch result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.catalog import tables as t
from gleaner.catalog.oracle_tables import iso
from gleaner.catalog.registry import query
from gleaner.catalog.state_queries import _BATCH, _FOLD
from gleaner.functions.times import build_time_range
from gleaner.operators import folds
from gleaner.session import shared_folder
from gleaner.streaming import incremental


_PARTS = 4


def _run_in_parts(frame, part, folder, writer_of, parts=_PARTS):
    """Write the rows whose ``part`` is 0, 1, ... one part after another, and stream each as one micro-batch."""
    spark = frame.sparkSession
    for number in range(parts):
        # all files that are new since the last run are one micro-batch
        frame.filter(part == number).write.mode("append").parquet(f"{folder}/input")
        stream = spark.readStream.schema(frame.schema).parquet(f"{folder}/input")
        incremental.run_to_end(writer_of(stream))


def _run_at_once(frame, part, folder, writer_of, parts=_PARTS):
    """The same with one stream: its micro-batches take as many files as the largest part has."""
    spark, most, before = frame.sparkSession, 1, 0
    for number in range(parts):
        frame.filter(part == number).write.mode("append").parquet(f"{folder}/input")
        files = len(spark.read.schema(frame.schema).parquet(f"{folder}/input").inputFiles())
        most, before = max(most, files - before), files
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", most).parquet(f"{folder}/input")
    incremental.run_to_end(writer_of(stream))


@query(f"""
    WITH {_BATCH}
    SELECT b.normalized_url, COALESCE(k.title, b.title) AS title, COALESCE(k.source_name, b.source_name) AS source_name,
           {iso("COALESCE(k.published_at, b.published_at)")} AS published_at, COALESCE(k.source_content, b.source_content) AS source_content
    FROM batch b LEFT JOIN known_pages k USING (normalized_url)""")
def streamed_upsert(spark, sf):
    folder = shared_folder(spark, "streamed-upsert")
    incremental.start_snapshots(t.known_pages(spark, sf), folder, "normalized_url")
    seen = t.sightings(spark, sf).withColumn("seen_at", F.lit("2025-01-01").cast("timestamp"))
    _run_in_parts(seen, F.col("ordinal") % _PARTS, folder, lambda stream: incremental.upsert_stream(stream, folder))
    return incremental.latest_snapshot(spark, folder).select("normalized_url", "title", "source_name", "published_at", "source_content")


@query(f"""
    WITH {_FOLD}
    SELECT id, CASE decision WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' WHEN 'low_confidence' THEN 'low_confidence'
                    ELSE status END AS status,
           CAST(retry_count + failed AS INTEGER) AS retry_count, {iso("COALESCE(published_at, found)")} AS published_at,
           {iso("COALESCE(accepted_at, collected_at)")} AS collected_at, {iso("COALESCE(last_at, updated_at)")} AS updated_at,
           CASE WHEN last_error IS NULL THEN error ELSE NULLIF(last_error[1], '') END AS error
    FROM fold""")
def streamed_fold(spark, sf):
    folder = shared_folder(spark, "streamed-fold")
    incremental.start_snapshots(folds.with_marks(t.articles(spark, sf)), folder, "id", folds.FOLDED)
    none = F.lit(None).cast("string")
    events = t.fetches(spark, sf).select(
        F.lit("fetch").alias("kind"), "id", "article_id", F.col("fetched_at").alias("at"), "status", "error",
        none.alias("decision"), "published_at",
    ).unionByName(
        t.evaluations(spark, sf).select(
            F.lit("evaluation").alias("kind"), "id", "article_id", F.col("evaluated_at").alias("at"), none.alias("status"),
            none.alias("error"), "decision", F.lit(None).cast("timestamp").alias("published_at"),
        )
    )
    # The events of an article are spread over the parts, in no order of time.
    part = F.pmod(F.xxhash64("id", "kind"), F.lit(_PARTS))
    _run_at_once(events, part, folder, lambda stream: incremental.fold_log_stream(stream, folder))
    return incremental.latest_snapshot(spark, folder, changing_only=True).select("id", "status", "retry_count", "published_at", "collected_at", "updated_at", "error")


@query(f"""
    SELECT {iso("date_trunc('hour', created_at)")} AS window_start, stage, status, COUNT(*) AS n FROM stage_history
    WHERE date_trunc('hour', created_at) + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', MAX(created_at)) FROM stage_history) - INTERVAL 10 MINUTE
    GROUP BY ALL""")
def streamed_stage_counts(spark, sf):
    folder = shared_folder(spark, "streamed-counts")
    history = t.stage_history(spark, sf).select("created_at", "stage", "status")
    # Two parts, the earlier half of the time first, so that no row is late.
    micros = F.unix_micros("created_at")
    middle = history.agg(((F.min(micros) + F.max(micros)) / 2).alias("middle")).first().middle or 0.0
    _run_in_parts(history, (micros > F.lit(middle)).cast("int"), folder, lambda stream: incremental.stage_counts(
        stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option(
        "path", f"{folder}/counts").outputMode("append"), parts=2)
    return spark.read.parquet(f"{folder}/counts").select("window_start", "stage", "status", "n")


def _discovery_run(spark, sf, purpose):
    """Counters of a streamed discovery: micro-batch ``b`` has the sightings whose ordinal leaves ``b`` when divided by four."""
    folder = shared_folder(spark, purpose)
    since, until = build_time_range("2024-03-20")
    incremental.start_snapshots(t.known_pages(spark, sf), folder, "normalized_url")
    seen = t.sightings(spark, sf).withColumn("seen_at", F.lit("2025-01-01").cast("timestamp"))
    states = t.read(spark, sf, "supplier").select(
        t.pick(["success", "failed", "not_modified", "success"], F.col("s_suppkey") % 4).alias("last_status")
    )
    logs = t.fetches(spark, sf), t.stage_history(spark, sf)
    _run_in_parts(seen, F.col("ordinal") % _PARTS, folder, lambda stream: incremental.discovery_stream(
        stream, folder, since, until, *logs, states))
    totals = [F.sum(name).alias(name) for name in ("found", "inserted", "queued_fetch", "skipped", "out_of_range")]
    # sources are polled once in a run, so every batch tells the same of them
    polled = [F.max(name).alias(name) for name in ("sources_failed", "sources_not_modified")]
    return spark.read.parquet(f"{folder}/counters").agg(*totals, *polled)


@query("""
    SELECT COUNT(*) AS found, COUNT(*) FILTER (WHERE published_at < TIMESTAMP '2024-03-20') AS out_of_range FROM sightings""")
def streamed_discovery_counters(spark, sf):
    """Counters per micro-batch add up to those of one run."""
    return _discovery_run(spark, sf, "streamed-counters").select("found", "out_of_range")


# Batches are taken in order.  An entry inside the window is inserted by the first batch that has one of its address, unless
# it was known from the start; later batches find it as a candidate under its new id.
@query(f"""
    WITH s AS (SELECT *, ordinal % {_PARTS} AS part, COALESCE(published_at < TIMESTAMP '2024-03-20', false) AS outside FROM sightings),
         p AS (SELECT normalized_url, part, MIN(ordinal) AS ordinal FROM s WHERE NOT outside GROUP BY ALL),
         fresh AS (SELECT normalized_url, MIN(part) AS part, arg_min(ordinal, part) AS ordinal FROM p
                   WHERE normalized_url NOT IN (SELECT normalized_url FROM known_pages) GROUP BY normalized_url),
         ids AS (SELECT normalized_url, id, status, -1 AS part FROM known_pages UNION ALL
                 SELECT normalized_url, (SELECT COALESCE(MAX(id), 0) FROM known_pages) + ROW_NUMBER() OVER (ORDER BY part, ordinal), 'candidate', part
                 FROM fresh),
         queued AS (SELECT COUNT(*) AS n FROM p JOIN ids USING (normalized_url) WHERE p.part = ids.part OR (status = 'candidate'
              AND id NOT IN (SELECT article_id FROM fetches WHERE status = 'success')
              AND id NOT IN (SELECT article_id FROM stage_history WHERE stage = 'fetch' AND status IN ('queued', 'running'))))
    SELECT COUNT(*) AS found, (SELECT COUNT(*) FROM fresh) AS inserted, (SELECT n FROM queued) AS queued_fetch,
           COUNT(*) - (SELECT COUNT(*) FROM fresh) AS skipped, COUNT(*) FILTER (WHERE outside) AS out_of_range,
           (SELECT COUNT(*) FROM sources WHERE k % 4 = 1) AS sources_failed, (SELECT COUNT(*) FROM sources WHERE k % 4 = 2) AS sources_not_modified
    FROM s""")
def streamed_discovery_run(spark, sf):
    """All counters of a streamed discovery run."""
    return _discovery_run(spark, sf, "streamed-discovery")


@query("""
    WITH f AS (SELECT * FROM stage_history WHERE stage = 'fetch'), e AS (SELECT * FROM stage_history WHERE stage = 'evaluate')
    SELECT f.id AS fetch_id, f.article_id, e.id AS evaluation_id, epoch_us(e.created_at) - epoch_us(f.created_at) AS micros
    FROM f JOIN e ON e.article_id = f.article_id AND e.created_at >= f.created_at AND e.created_at <= f.created_at + INTERVAL 12 HOUR""")
def streamed_latencies(spark, sf):
    """Time from a fetch stage to the evaluations of its article within twelve hours, as two joined streams."""
    folder = shared_folder(spark, "streamed-latencies")
    history = t.stage_history(spark, sf).select("id", "article_id", "stage", "created_at")
    # the earlier half of the time first, so that no row is late
    micros = F.unix_micros("created_at")
    middle = history.agg(((F.min(micros) + F.max(micros)) / 2).alias("middle")).first().middle or 0.0

    def writer(stream):
        sides = [stream.filter(F.col("stage") == stage).withColumnRenamed("created_at", at) for stage, at in (("fetch", "fetched_at"), ("evaluate", "evaluated_at"))]
        return incremental.latency_stream(incremental.stage_latencies(*sides, within="12 hours"), folder)

    _run_in_parts(history, (micros > F.lit(middle)).cast("int"), folder, writer, parts=2)
    return spark.read.parquet(f"{folder}/latencies").select("fetch_id", "article_id", "evaluation_id", "micros")
