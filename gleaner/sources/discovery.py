"""The discovery run: registry and fetched bodies to entries, state and counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.sources.feeds import feed_entries, parse_feeds
from gleaner.sources.listings import listing_entries, parse_listings
from gleaner.sources.registry import enabled_feeds
from gleaner.sources.sitemaps import expand_sitemaps

_ENTRY = ["source_name", "ordinal", "title", "url", "published_at", "source_tags", "source_content",
          "source_content_metadata"]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def read_sources(
    sources: DataFrame, bodies: DataFrame, documents: DataFrame, checked_at: Column
) -> tuple[DataFrame, DataFrame]:
    """Turn the bodies of all enabled sources into entries and source states.

    ``sources`` carries ``feed_url``/``feed_error`` (see ``with_feed_url``),
    ``bodies`` has one row per polled source (schema ``RAW_BODIES``), and
    ``documents`` holds ``(url, body)`` of nested sitemaps.  A source that cannot
    be read gives a ``failed`` state and no entries; others go on.
    """
    polled = enabled_feeds(sources).withColumnRenamed("name", "source_name").join(bodies, "source_name", "left")
    request_error = (
        F.when(F.col("feed_error").isNotNull(), F.col("feed_error"))
        .when(F.col("fetch_error").isNotNull(), F.col("fetch_error"))
        .when(F.col("http_status").isNull(), F.lit("no response"))
        .when(F.col("http_status") >= 400, F.concat(F.lit("HTTP status "), F.col("http_status").cast("string")))
    )
    polled = polled.withColumn("request_error", request_error).withColumnRenamed("tags", "source_tags")
    unchanged = F.col("request_error").isNull() & (F.col("http_status") == 304)
    ready = polled.filter(F.col("request_error").isNull() & (F.col("http_status") != 304))

    feeds = parse_feeds(ready.filter(F.col("feed.type").isin("direct", "rsshub")))
    listings = parse_listings(ready.filter(F.col("feed.type") == "listing"))
    maps = ready.filter(F.col("feed.type") == "sitemap")
    roots = maps.select("source_name", F.col("feed_url").alias("url"), "body", "position", "source_tags")
    map_entries, map_failures = expand_sitemaps(roots, documents, "position", "source_tags")

    def shaped(frame: DataFrame, at: Column) -> DataFrame:
        return frame.select(
            "source_name",
            (F.col("position").cast("bigint") * F.lit(1 << 32) + at).alias("ordinal"),
            "title",
            "url",
            "published_at",
            "source_tags",
            F.lit(None).cast("string").alias("source_content"),
            F.lit(None).cast("map<string,string>").alias("source_content_metadata"),
        )

    entries = _union(
        [
            feed_entries(feeds).select(*_ENTRY),
            shaped(
                listing_entries(listings, "source_name", "position", "source_tags").withColumn("published_at", F.lit(None).cast("timestamp")),
                F.col("at").cast("bigint"),
            ),
            shaped(map_entries, F.col("visit").cast("bigint") * F.lit(1 << 26) + F.col("at")),
        ]
    )
    failures = _union(
        [
            feeds.filter(F.col("parse_error").isNotNull()).select("source_name", F.col("parse_error").alias("error")),
            listings.filter(F.col("parse_error").isNotNull()).select("source_name", F.col("parse_error").alias("error")),
            map_failures,
        ]
    )
    states = polled.join(failures, "source_name", "left").select(
        "source_name",
        F.when(F.coalesce("request_error", "error").isNull() & ~unchanged, F.col("etag")).alias("etag"),
        F.when(F.coalesce("request_error", "error").isNull() & ~unchanged, F.col("modified")).alias("modified"),
        F.when(F.coalesce("request_error", "error").isNotNull(), F.lit("failed"))
        .when(unchanged, F.lit("not_modified"))
        .otherwise(F.lit("success"))
        .alias("last_status"),
        F.coalesce("request_error", "error").alias("last_error"),
        checked_at.alias("checked_at"),
    )
    return entries, states
