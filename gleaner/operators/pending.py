"""What is due: sets of articles waiting for a stage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.constants import ACTIVE_QUEUE_STATUSES, MAX_RETRY


def _fetched(fetches: DataFrame) -> DataFrame:
    """Articles with a successful fetch; distinct, so a long log of one article
    collapses before the shuffle of the join it feeds."""
    return fetches.filter(F.col("status") == "success").select("article_id").distinct()


def ready_for_fetch(articles: DataFrame, fetches: DataFrame, max_retry: int = MAX_RETRY) -> DataFrame:
    """Candidates with retries left and no successful fetch."""
    due = articles.filter((F.col("status") == "candidate") & (F.col("retry_count") < max_retry))
    done = _fetched(fetches)
    return due.join(done, due.id == done.article_id, "left_anti")


def ready_for_evaluation(articles: DataFrame, fetches: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Candidates that were fetched and never evaluated."""
    due = articles.filter(F.col("status") == "candidate")
    fetched, evaluated = _fetched(fetches), evaluations.select("article_id").distinct()
    return due.join(fetched, due.id == fetched.article_id, "left_semi").join(
        evaluated, due.id == evaluated.article_id, "left_anti"
    )


def queued_items(history: DataFrame, articles: DataFrame, stage: str, limit: int | None = None) -> DataFrame:
    """Queued rows of a stage with their articles, oldest first."""
    queued = history.filter((F.col("stage") == stage) & (F.col("status") == "queued"))
    q = queued.select(
        F.col("id").alias("queue_id"),
        "article_id",
        F.col("stage").alias("queue_stage"),
        F.col("status").alias("queue_status"),
        "range_since",
        "range_until",
    )
    if limit is not None:
        # the page is cut on ids alone; articles are looked up for it afterwards
        stored = articles.select(F.col("id").alias("article_id"))
        q = q.join(stored, "article_id", "left_semi").orderBy("queue_id").limit(limit)
    return q.join(articles, q.article_id == articles.id).drop("article_id").orderBy("queue_id")


def enqueue(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Requests to add: one per (article, stage), and none while one is active.

    ``requests`` has ``article_id, stage, range_since, range_until, ordinal``;
    the first request of a pair wins.
    """
    pair = ["article_id", "stage"]
    active = history.filter(F.col("status").isin(ACTIVE_QUEUE_STATUSES)).select(*pair).distinct()
    first = requests.groupBy(*pair).agg(
        F.min_by(F.struct("ordinal", "range_since", "range_until"), "ordinal").alias("_first")
    )
    return first.join(active, pair, "left_anti").select(
        *pair, "_first.range_since", "_first.range_until", "_first.ordinal", F.lit("queued").alias("status")
    )


def fetch_requests(sightings: DataFrame, articles: DataFrame, fetches: DataFrame, history: DataFrame) -> DataFrame:
    """Fetch requests after discovery: candidates without a successful fetch.

    ``sightings`` has ``article_id, ordinal, range_since, range_until``.
    """
    open_articles = articles.filter(F.col("status") == "candidate").select("id")
    due = sightings.join(open_articles, sightings.article_id == open_articles.id, "left_semi").join(
        _fetched(fetches), "article_id", "left_anti"
    )
    return enqueue(due.withColumn("stage", F.lit("fetch")), history)


def by_ids(articles: DataFrame, ids: DataFrame | Iterable[int]) -> DataFrame:
    """Explicitly chosen articles, in id order."""
    if isinstance(ids, DataFrame):
        chosen = articles.join(ids.select("id"), "id", "left_semi")
    else:
        chosen = articles.filter(F.col("id").isin([int(i) for i in ids]))
    return chosen.orderBy("id")


def lookup(frame: DataFrame, key: str, value: object | DataFrame) -> DataFrame:
    """Point lookup by one value, or by a frame of keys."""
    if isinstance(value, DataFrame):
        return frame.join(value.select(key).distinct(), key, "left_semi")
    return frame.filter(F.col(key) == F.lit(value))
