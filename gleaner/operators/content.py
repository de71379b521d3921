"""Content acquisition over tables: choice, size guard, window re-check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.constants import (
    CRAWLER_FEED_ENTRY,
    ERROR_EMPTY_CONTENT,
    ERROR_OUT_OF_RANGE,
    FALLBACK_TARGET,
)
from gleaner.functions.text import content_bytes, non_blank
from gleaner.functions.times import in_range


def choose_content(articles: DataFrame, pages: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """One fetch outcome per article to fetch.

    Content that came with the feed is used, else the page's.  Empty content is a
    failed outcome with its reason.  With ``max_bytes`` (``MAX_CONTENT_BYTES`` is
    the usual one) oversized feed content gives way to the page, and an oversized
    page fails.  ``pages`` has ``url, content, published_at, fetch_error`` of crawled
    pages and optionally the crawler's ``metadata`` and ``crawled_at``.  Of several
    crawls of one address the latest counts: by ``crawled_at`` if there, a crawl
    without error first otherwise.
    """
    own = non_blank(F.col("source_content"))
    fields = [F.col(name) for name in pages.columns if name != "url"]
    turn = [F.col("crawled_at")] if "crawled_at" in pages.columns else []
    latest = F.max_by(F.struct(*fields), F.struct(*turn, F.col("fetch_error").isNull(), "published_at", F.xxhash64("content")))
    pages = pages.groupBy("url").agg(latest.alias("_crawl")).select("url", "_crawl.*")
    page = pages.select(
        "url",
        F.col("content").alias("page_content"),
        F.col("published_at").alias("page_published_at"),
        "fetch_error",
        (F.col("metadata") if "metadata" in pages.columns else F.lit(None).cast("map<string,string>")).alias(
            "page_metadata"
        ),
    )
    use_own = own.isNotNull() if max_bytes is None else F.coalesce(content_bytes(own) <= max_bytes, F.lit(False))
    joined = articles.withColumn("own", F.when(use_own, own)).join(page, "url", "left")
    from_feed = F.col("own").isNotNull()
    content = F.coalesce("own", non_blank(F.col("page_content")))
    size = content_bytes(content)
    error = (
        F.when(from_feed, F.lit(None).cast("string"))
        .when(F.col("fetch_error").isNotNull(), F.col("fetch_error"))
        .when(content.isNull(), F.lit(ERROR_EMPTY_CONTENT))
    )
    if max_bytes is not None:
        error = error.when(size > max_bytes, F.concat(F.lit("markdown too large: "), size.cast("string"), F.lit(f" > {max_bytes}")))
    feed_metadata = F.map_concat(
        F.map_filter(
            F.coalesce("source_content_metadata", F.create_map().cast("map<string,string>")),
            lambda k, _: ~k.isin("crawler", "url", "fallback_target"),
        ),
        F.create_map(
            F.lit("crawler"), F.lit(CRAWLER_FEED_ENTRY),
            F.lit("url"), F.col("url"),
            F.lit("fallback_target"), F.lit(FALLBACK_TARGET),
        ),
    )
    page_metadata = F.coalesce("page_metadata", F.create_map(F.lit("url"), F.col("url")))
    return joined.select(
        F.col("id").alias("article_id"),
        F.when(error.isNull(), F.lit("success")).otherwise(F.lit("failed")).alias("status"),
        F.when(error.isNull(), content).alias("content"),
        error.alias("error"),
        F.when(error.isNull(), F.when(from_feed, feed_metadata).otherwise(page_metadata)).alias("metadata"),
        F.when(error.isNull(), F.when(from_feed, F.col("published_at")).otherwise(F.col("page_published_at"))).alias(
            "published_at"
        ),
    )


def recheck_window(outcomes: DataFrame, articles: DataFrame, since: Column | None, until: Column | None) -> DataFrame:
    """Fetch outcomes with the stage status after the window is checked again.

    The check uses the article's publication time, which a successful fetch may
    just have filled.  ``next_stage`` is ``evaluate`` only for articles inside.
    """
    known = articles.select(F.col("id").alias("article_id"), F.col("published_at").alias("known_published_at"))
    effective = F.coalesce("known_published_at", "published_at")
    stage = (
        F.when(F.col("status") == "failed", F.lit("failed"))
        .when(~in_range(effective, since, until), F.lit("skipped_out_of_range"))
        .otherwise(F.lit("succeeded"))
    )
    return outcomes.join(known, "article_id").withColumn("stage_status", stage).withColumns(
        {
            "published_at": effective,
            "error": F.when(F.col("stage_status") == "skipped_out_of_range", F.lit(ERROR_OUT_OF_RANGE)).otherwise(
                F.col("error")
            ),
            "next_stage": F.when(F.col("stage_status") == "succeeded", F.lit("evaluate")),
        }
    ).drop("known_published_at")


def fetch_counters(checked: DataFrame, active_evaluations: DataFrame | None = None) -> DataFrame:
    """Counters of a fetch run (see ``recheck_window``)."""
    queued = F.col("next_stage").isNotNull()
    if active_evaluations is not None:
        busy = active_evaluations.select("article_id").distinct().withColumn("busy", F.lit(True))
        checked = checked.join(busy, "article_id", "left")
        queued = queued & F.col("busy").isNull()
    return checked.agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(F.col("stage_status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("stage_status") == "failed").alias("failed"),
        F.count_if(F.col("stage_status") == "skipped_out_of_range").alias("skipped"),
        F.count_if(queued).alias("queued_evaluate"),
    )
