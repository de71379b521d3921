"""Row filters of the listings."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import like_ascii
from gleaner.functions.times import in_range, parse_datetime


def by_status(frame: DataFrame, status: str | None) -> DataFrame:
    """Exact status; ``unaccepted`` is every other one; empty or ``all`` is no filter."""
    if not status or status == "all":
        return frame
    if status == "unaccepted":
        return frame.filter(F.col("status") != "accepted")
    return frame.filter(F.col("status") == status)


def by_source(frame: DataFrame, source: str | None) -> DataFrame:
    return frame.filter(F.col("source_name") == source) if source else frame


def matching(frame: DataFrame, needle: str | None, *names: str) -> DataFrame:
    """Substring search over any of the columns (``%`` and ``_`` are wildcards)."""
    if not needle:
        return frame
    return frame.filter(reduce(or_, [like_ascii(F.col(name), needle) for name in names]))


def published_between(frame: DataFrame, since: str | None, until: str | None) -> DataFrame:
    """Half-open filter on the publication time; an unknown time does not pass."""
    lower = parse_datetime(F.lit(since)) if since else None
    upper = parse_datetime(F.lit(until), date_as_end=True) if until else None
    # A bound that cannot be read is no bound.
    if lower is not None:
        frame = frame.filter(lower.isNull() | (F.col("published_at") >= lower))
    if upper is not None:
        frame = frame.filter(upper.isNull() | (F.col("published_at") < upper))
    return frame


def failed_article_ids(fetches: DataFrame, evaluations: DataFrame, failures: DataFrame) -> DataFrame:
    """Articles whose latest fetch failed, or whose evaluation failed and never succeeded.

    Only ids are aggregated, in hash tables, so no log is sorted.
    """
    failed_id = F.when(F.col("status") == "failed", F.col("id"))
    ids = fetches.groupBy("article_id").agg(F.max("id").alias("latest"), F.max(failed_id).alias("latest_failed"))
    fetch_failed = ids.filter(F.col("latest") == F.col("latest_failed")).select("article_id")
    evaluated = evaluations.select("article_id").distinct()
    never_evaluated = failures.select("article_id").distinct().join(evaluated, "article_id", "left_anti")
    return fetch_failed.unionByName(never_evaluated)


def failed_only(articles: DataFrame, fetches: DataFrame, evaluations: DataFrame, failures: DataFrame) -> DataFrame:
    failed = failed_article_ids(fetches, evaluations, failures)
    return articles.join(failed, articles.id == failed.article_id, "left_semi")


def with_window_flag(entries: DataFrame, since: Column | None, until: Column | None) -> DataFrame:
    """Mark entries outside the discovery window; an unknown time is inside."""
    return entries.withColumn("out_of_range", ~in_range(F.col("published_at"), since, until))
