"""Counts and reports over the state tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.constants import ARTICLE_STATUSES
from gleaner.operators.latest import latest, latest_fetch
from gleaner.plans.paging import Order, cursor_envelope, cursor_page, ordering
from gleaner.session import written


def status_counts(articles: DataFrame) -> DataFrame:
    """Rows per status, every known status present."""
    known = articles.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ARTICLE_STATUSES))).alias("status"))
    counts = articles.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return known.join(counts, "status", "full_outer").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def fetch_failed_ids(fetches: DataFrame) -> DataFrame:
    """Articles whose latest fetch failed, with its error."""
    return latest_fetch(fetches).filter(F.col("status") == "failed").select("article_id", "error")


def evaluation_failed_ids(evaluations: DataFrame, failures: DataFrame) -> DataFrame:
    """Articles whose evaluation failed and never succeeded, with the latest error."""
    evaluated = evaluations.select("article_id").distinct()
    return latest(failures, "article_id", "error").join(evaluated, "article_id", "left_anti")


def summary(articles: DataFrame, fetches: DataFrame, evaluations: DataFrame, failures: DataFrame) -> DataFrame:
    """Total, count per status, and the two failure counts, in one row."""
    statuses = [F.count_if(F.col("status") == s).alias(s) for s in ARTICLE_STATUSES]
    fetch_failed = fetch_failed_ids(fetches).agg(F.count(F.lit(1)).alias("n")).scalar()
    evaluation_failed = evaluation_failed_ids(evaluations, failures).agg(F.count(F.lit(1)).alias("n")).scalar()
    return articles.agg(F.count(F.lit(1)).alias("total"), *statuses).withColumns(
        {"fetch_failed": fetch_failed, "evaluation_failed": evaluation_failed}
    )


def tag_counts(vocabulary: DataFrame, links: DataFrame) -> DataFrame:
    """Articles per tag, unused tags with zero."""
    counts = links.groupBy("tag_id").agg(F.count(F.lit(1)).alias("article_count"))
    return vocabulary.join(counts, vocabulary.id == counts.tag_id, "left").select(
        "id", "name", "status", F.coalesce("article_count", F.lit(0)).alias("article_count")
    )


def source_names(articles: DataFrame) -> DataFrame:
    return articles.select("source_name").distinct().orderBy("source_name")


def run_history(runs: DataFrame, limit: int = 100) -> DataFrame:
    """Latest runs first, with the time each took."""
    seconds = F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")
    return runs.withColumn("seconds", seconds).orderBy(F.desc("created_at"), F.desc("job_id")).limit(limit)


FAILURE_KEYS: Order = [("article_id", True), ("stage", True)]


def standing_failures(fetches: DataFrame, evaluations: DataFrame, failures: DataFrame) -> DataFrame:
    """article_id, error and stage of the failed fetches and evaluations that still stand."""
    return fetch_failed_ids(fetches).withColumn("stage", F.lit("fetch")).unionByName(
        evaluation_failed_ids(evaluations, failures).withColumn("stage", F.lit("evaluation"))
    )


def _named(failed: DataFrame, articles: DataFrame) -> DataFrame:
    named = articles.select(F.col("id").alias("article_id"), "title", "url")
    return failed.join(named, "article_id").select("article_id", "title", "url", "stage", "error")


def failure_report(articles: DataFrame, fetches: DataFrame, evaluations: DataFrame, failures: DataFrame) -> DataFrame:
    """Failed fetches and evaluations that still stand, by article and stage."""
    return _named(standing_failures(fetches, evaluations, failures), articles).orderBy(*ordering(FAILURE_KEYS))


def failure_report_page(
    articles: DataFrame, fetches: DataFrame, evaluations: DataFrame, failures: DataFrame, page_size: int = 50,
    cursor: Mapping[str, object] | None = None,
) -> DataFrame:
    """One page of the report, the total of all failures and the cursor of the next page, in one row.

    Log rows of articles before the cursor aren't looked at for the page, and only the
    page's articles are looked up; a failure always belongs to a stored article.
    """
    total = standing_failures(fetches, evaluations, failures)
    logs = [fetches, evaluations, failures]
    if cursor:
        logs = [log.filter(F.col("article_id") >= F.lit(cursor["article_id"])) for log in logs]
    page = written(cursor_page(standing_failures(*logs), FAILURE_KEYS, page_size, cursor), "failure-page")
    known = articles.join(page.select(F.col("article_id").alias("id")).distinct(), "id", "left_semi")
    return cursor_envelope(_named(page, known), total, FAILURE_KEYS)
