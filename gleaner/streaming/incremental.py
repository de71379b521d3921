"""Incremental runs on Structured Streaming.

State is a table in hash buckets (``buckets``): micro-batch ``n`` reads the rows of
its keys from version ``n`` and writes version ``n + 1``, of which only what it
touches is new.  A batch that is replayed after a failure reads what it read before
and leaves the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from gleaner.functions.times import in_range
from gleaner.operators.filters import with_window_flag
from gleaner.operators.folds import fold_state
from gleaner.operators.upsert import discovery_counters, folded_entries, known_urls, upsert_folded
from gleaner.session import path_exists
from gleaner.streaming.buckets import Buckets, buckets_for

Counters = Callable[[DataFrame, DataFrame], DataFrame]


def start_snapshots(
    articles: DataFrame, folder: str, key: str | None = None, changing: tuple[str, ...] | None = None, buckets: int | None = None
) -> None:
    """Write the state before the first micro-batch.

    ``key`` is the column the stream finds articles by (``id`` for logs, ``normalized_url``
    for entries), unique and never null; without it the first stream on the folder deals
    the rows into buckets.  Columns that aren't ``changing`` are written once and apart,
    so that batches don't carry them.  The number of buckets follows the number of rows.
    """
    if changing:
        articles.drop(*changing).write.mode("overwrite").parquet(f"{folder}/constant")
        articles = articles.select(key, *changing)
    if key:
        known = articles.agg(F.count("*"), F.coalesce(F.max("id"), F.lit(0))).first()
        Buckets.create(articles, f"{folder}/state", key, buckets or buckets_for(known[0]), top_id=known[1])
    else:
        articles.write.mode("overwrite").parquet(f"{folder}/start")


def _prepared(spark: SparkSession, folder: str, key: str) -> None:
    """Buckets for a stream that finds articles by ``key``."""
    if path_exists(spark, f"{folder}/state/manifest-*"):
        held = Buckets.latest(spark, f"{folder}/state").key
        if held != key:
            raise ValueError(f"the state in {folder} is kept by {held}, not by {key}")
    else:
        start_snapshots(spark.read.parquet(f"{folder}/start"), folder, key)


def read_snapshot(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """The articles as the given number of micro-batches left them (the two newest versions are kept)."""
    return _whole(spark, folder, Buckets.load(spark, f"{folder}/state", version))


def latest_snapshot(spark: SparkSession, folder: str, changing_only: bool = False) -> DataFrame:
    """The newest version that was written to its end, with its constant columns unless told otherwise."""
    if not path_exists(spark, f"{folder}/state/manifest-*"):
        return spark.read.parquet(f"{folder}/start")
    state = Buckets.latest(spark, f"{folder}/state")
    return state.rows() if changing_only else _whole(spark, folder, state)


def _whole(spark: SparkSession, folder: str, state: Buckets) -> DataFrame:
    if not path_exists(spark, f"{folder}/constant"):
        return state.rows()
    return spark.read.parquet(f"{folder}/constant").join(state.rows(), state.key)


def _each_batch(stream: DataFrame, folder: str, apply: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    def held(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            apply(kept, number)
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(held).option("checkpointLocation", f"{folder}/checkpoint")


def _entry_stream(entries: DataFrame, folder: str, within: Callable[[DataFrame], DataFrame], counters: Counters | None = None) -> DataStreamWriter:
    """Entries folded into articles by address; slugs in use are kept in buckets of their own."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state, slugs = Buckets.load(spark, f"{folder}/state", number), Buckets.load(spark, f"{folder}/slugs", number)
        folded = folded_entries(within(batch))
        touched = state.touched(folded)
        before = state.before(folded, touched).persist()
        if counters:
            urls = known_urls(batch)
            known = state.having(urls, state.touched(urls))
            write_counters(counters(known, batch), folder, number)
        bases = folded.select(F.col("base").alias("slug")).distinct()
        taken = slugs.having(bases, slugs.touched(bases))
        as_of = batch.agg(F.max("seen_at")).scalar()
        after = upsert_folded(before, folded, as_of, taken, F.lit(state.facts["top_id"])).persist()
        top = after.agg(F.max("id")).first()[0] or 0
        new = state.advanced(after, touched, top_id=max(state.facts["top_id"], top))
        used = after.filter(F.col("id") > state.facts["top_id"]).select("slug").distinct()
        places = slugs.touched(used)
        new_slugs = slugs.advanced(slugs.before(used, places).unionByName(used).distinct(), places)
        for one in (after, before):
            one.unpersist()
        for one in (new, new_slugs):
            one.forget_before()

    spark = entries.sparkSession
    _prepared(spark, folder, "normalized_url")
    if not path_exists(spark, f"{folder}/slugs/manifest-*"):
        state = Buckets.load(spark, f"{folder}/state", 0)
        Buckets.create(state.rows().select("slug").distinct(), f"{folder}/slugs", "slug", state.count)
    return _each_batch(entries, folder, apply)


def discovery_stream(
    entries: DataFrame, folder: str, since: Column | None, until: Column | None, fetches: DataFrame, history: DataFrame, states: DataFrame
) -> DataStreamWriter:
    """Incremental discovery as in ``upsert_stream``, with the counters of every micro-batch.

    A batch is counted against the state before it, so what an earlier batch
    inserted is known and not inserted again.
    """

    def counters(before: DataFrame, batch: DataFrame) -> DataFrame:
        return discovery_counters(with_window_flag(batch, since, until), before, fetches, history, states)

    return _entry_stream(entries, folder, lambda batch: batch.filter(in_range(F.col("published_at"), since, until)), counters)


def upsert_stream(
    entries: DataFrame,
    folder: str,
    since: Column | None = None,
    until: Column | None = None,
    dedup_within: str | None = None,
) -> DataStreamWriter:
    """Incremental discovery: entries with ``seen_at`` into articles.

    The upsert itself is exact over all time.  ``dedup_within`` additionally
    drops repeated identical entries that arrive within that time of each other,
    before they reach it.  A batch is stamped with its latest ``seen_at``.
    """
    inside = entries.filter(in_range(F.col("published_at"), since, until))
    if dedup_within:
        same = F.xxhash64("url", "title", "source_name", "published_at", "source_content")
        inside = (
            inside.withColumn("_same", same)
            .withWatermark("seen_at", dedup_within)
            .dropDuplicatesWithinWatermark(["_same", "url"])
            .drop("_same")
        )
    return _entry_stream(inside, folder, lambda batch: batch)


def fold_log_stream(events: DataFrame, folder: str) -> DataStreamWriter:
    """Fetch and evaluation events (``kind`` fetch or evaluation) into article state.

    The first state has to come from ``with_marks``; then events may arrive in any
    order and in any batches.
    """

    def apply(batch: DataFrame, number: int) -> None:
        state = Buckets.load(batch.sparkSession, f"{folder}/state", number)
        keys = batch.filter(F.col("article_id").isNotNull()).select(F.col("article_id").alias("id")).distinct()
        touched = state.touched(keys)
        fetches = batch.filter("kind = 'fetch'").select(
            "id", "article_id", F.col("at").alias("fetched_at"), "status", "error", "published_at"
        )
        evaluations = batch.filter("kind = 'evaluation'").select(
            "id", "article_id", F.col("at").alias("evaluated_at"), "decision"
        )
        after = fold_state(state.before(keys, touched), fetches, evaluations)
        state.advanced(after, touched).forget_before()

    _prepared(events.sparkSession, folder, "id")
    return _each_batch(events, folder, apply)


def stage_counts(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Outcomes per stage and status in tumbling windows; later rows are dropped.

    Emits a window once the watermark has passed its end.
    """
    return (
        events.withWatermark("created_at", delay)
        .groupBy(F.window("created_at", window), "stage", "status")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "stage", "status", "n")
    )


def stage_latencies(fetched: DataFrame, evaluated: DataFrame, within: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Each successful fetch with the evaluations of its article that follow within some time.

    ``fetched`` has id, article_id and fetched_at, ``evaluated`` id, article_id and
    evaluated_at.  Both sides have a watermark, so state is held for ``within`` and ``delay``
    only.  A fetch that no evaluation followed comes with nulls once the watermark has
    passed its time; rows behind the watermark are dropped (``late_rows`` finds them).
    """
    f = fetched.select(F.col("id").alias("fetch_id"), F.col("article_id").alias("of"), "fetched_at").withWatermark("fetched_at", delay)
    e = evaluated.select(F.col("id").alias("evaluation_id"), "article_id", "evaluated_at").withWatermark("evaluated_at", delay)
    follows = F.expr(f"of = article_id AND evaluated_at >= fetched_at AND evaluated_at <= fetched_at + INTERVAL {within}")
    return f.join(e, follows, "left_outer").select(
        "fetch_id", F.col("of").alias("article_id"), "fetched_at", "evaluation_id", "evaluated_at",
        (F.unix_micros("evaluated_at") - F.unix_micros("fetched_at")).alias("micros"),
    )


def latency_stream(latencies: DataFrame, folder: str) -> DataStreamWriter:
    """Matched rows to ``latencies``, fetches without an evaluation to ``unmatched``; a replayed batch overwrites its own."""

    def apply(batch: DataFrame, number: int) -> None:
        matched = F.col("evaluation_id").isNotNull()
        for name, rows in (("latencies", batch.filter(matched)), ("unmatched", batch.filter(~matched).drop("evaluation_id", "evaluated_at", "micros"))):
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/run={number}")

    return _each_batch(latencies, folder, apply)


def late_rows(fetched: DataFrame, spark: SparkSession, folder: str, until: Column) -> DataFrame:
    """Fetches up to a time the watermark has passed that came too late to be told of: in neither table."""
    told = spark.read.parquet(f"{folder}/latencies").select("fetch_id").unionByName(spark.read.parquet(f"{folder}/unmatched").select("fetch_id"))
    due = fetched.filter(F.col("fetched_at") <= until)
    return due.join(told.distinct(), due.id == F.col("fetch_id"), "left_anti")


def write_counters(counters: DataFrame, folder: str, number: int) -> None:
    counters.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/counters/run={number}")


def counter_stream(stream: DataFrame, folder: str, counters: Callable[[DataFrame], DataFrame]) -> DataStreamWriter:
    """Counters of every micro-batch, one overwritten folder per batch."""

    def apply(batch: DataFrame, number: int) -> None:
        write_counters(counters(batch), folder, number)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{folder}/checkpoint")


def run_to_end(writer: DataStreamWriter) -> None:
    """Process all that is there, in as many micro-batches as it takes, and stop."""
    writer.trigger(availableNow=True).start().awaitTermination()
