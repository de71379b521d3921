"""Latest row per key.  "Latest" is by id, as ids follow the order of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.membership import id_bitmaps, possibly_in


def latest(log: DataFrame, key: str, *fields: str, order: str = "id", where: Column | None = None) -> DataFrame:
    """The given fields of the latest row of every key.

    One aggregation with a partial step per input partition, so a key that holds
    a large share of the log is reduced before the shuffle.
    """
    if where is not None:
        log = log.filter(where)
    names = fields or [name for name in log.columns if name != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("_row")).select(key, "_row.*")


def latest_ids(log: DataFrame, key: str, where: Column | None = None) -> DataFrame:
    """Only the id of the latest row of every key."""
    if where is not None:
        log = log.filter(where)
    return log.groupBy(key).agg(F.max("id").alias("id"))


def latest_rows(log: DataFrame, key: str, where: Column | None = None) -> DataFrame:
    """Whole latest rows of logs with bulky columns.

    The key is aggregated without the bulk; the rows are then fetched by their
    unique id, which spreads evenly whatever the skew of the key.
    """
    return log.join(latest_ids(log, key, where).select("id"), "id", "left_semi")


def with_fetch_ids(rows: DataFrame, fetches: DataFrame, key: str = "id", how: str = "inner") -> DataFrame:
    """Add ``fetch_id``, the latest successful fetch of each article."""
    found = latest_ids(fetches, "article_id", F.col("status") == "success").select(F.col("article_id").alias("_of"), F.col("id").alias("fetch_id"))
    return rows.join(found, F.col(key) == F.col("_of"), how).drop("_of")


def with_content(rows: DataFrame, fetches: DataFrame, how: str = "inner") -> DataFrame:
    """Add ``content`` and ``fetched_at`` of the fetches in ``fetch_id`` (dropped), the last thing to do.

    The rows are narrow until here.  Bitmaps of the ids they chose filter the bulky
    log where it is read, so only chosen content takes part in the one shuffle.  The
    rows are read twice: write them first.
    """
    chosen = possibly_in(fetches.select(F.col("id").alias("_content_id"), "content", "fetched_at"), "_content_id", id_bitmaps(rows, "fetch_id"))
    return rows.join(chosen, F.col("fetch_id") == F.col("_content_id"), how).drop("fetch_id", "_content_id")


def with_latest_content(rows: DataFrame, fetches: DataFrame, key: str = "id", how: str = "inner", found: DataFrame | None = None) -> DataFrame:
    """Add ``content`` and ``fetched_at`` of the latest successful fetch of each article.

    Bitmaps of the ids of those fetches (``found``, if known already: ``article_id, id``) filter
    the bulky log where it is read, and its rows go by article, so that the article's other facts
    take part in no further shuffle.  Where ids share bits an older fetch may pass; the latest
    of an article is always among those that do.
    """
    good = fetches.filter(F.col("status") == "success").select("article_id", "id", "content", "fetched_at")
    chosen = possibly_in(good, "id", id_bitmaps(latest_ids(good, "article_id") if found is None else found, "id"))
    content = latest(chosen, "article_id", "content", "fetched_at").withColumnRenamed("article_id", "_of")
    return rows.join(content, F.col(key) == F.col("_of"), how).drop("_of")


def latest_fetch(fetches: DataFrame) -> DataFrame:
    return latest(fetches, "article_id", "id", "status", "error")


def latest_successful_fetch(fetches: DataFrame) -> DataFrame:
    return latest_rows(fetches, "article_id", F.col("status") == "success")


def latest_evaluation(evaluations: DataFrame) -> DataFrame:
    return latest(
        evaluations, "article_id", "id", "decision", "content_type", "summary", "recommendation_reason"
    )


def latest_failure(failures: DataFrame) -> DataFrame:
    return latest(failures, "article_id", "id", "error", "attempts")


def stage_status(history: DataFrame) -> DataFrame:
    """Latest fetch and evaluate status of every article, side by side."""
    return history.groupBy("article_id").agg(
        *[
            F.max_by(F.when(F.col("stage") == stage, F.col("status")), F.when(F.col("stage") == stage, F.col("id"))).alias(
                f"{stage}_queue_status"
            )
            for stage in ("fetch", "evaluate")
        ]
    )


def last_n(log: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The last ``n`` rows of every key (Spark limits each partition before the shuffle)."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("id")))
    return log.withColumn("recency", rank).filter(F.col("recency") <= n)


def latest_schedule_run(runs: DataFrame) -> DataFrame:
    """Latest run of every schedule, by creation time."""
    scheduled = runs.filter(F.col("schedule_id").isNotNull())
    order = F.struct("created_at", "job_id")
    names = [name for name in runs.columns if name != "schedule_id"]
    return scheduled.groupBy("schedule_id").agg(F.max_by(F.struct(*names), order).alias("_row")).select(
        "schedule_id", "_row.*"
    )
