"""Listing pages to entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.charsets import with_body_text
from gleaner.functions.html import select_links
from gleaner.functions.text import strip
from gleaner.functions.urls import origin, resolve_url


def parse_listings(pages: DataFrame) -> DataFrame:
    """Add the selected ``links``, ``titles`` and ``parse_error``.

    Needs ``body`` and a ``feed`` struct with the selectors.
    """
    picked = with_body_text(pages).withColumn(
        "_picked",
        select_links(F.col("_text"), F.col("feed.link_selector"), F.col("feed.title_selector")),
    )
    return picked.select(
        *pages.columns,
        F.coalesce(
            F.when(F.col("body").isNull(), F.lit("listing body is missing"))
            .when(F.col("_text").isNull(), F.lit("listing body cannot be decoded")),
            "_picked.error",
        ).alias("parse_error"),
        F.col("_picked.links").alias("links"),
        F.col("_picked.titles").alias("titles"),
    )


def listing_entries(parsed: DataFrame, *keep: str) -> DataFrame:
    """Article links of listing pages.

    Relative links resolve against the feed's base or else the page's origin.  A
    title node belongs to the link with the same position among *all* selected
    nodes; without one the link text or else the address is the title.
    """
    feed = F.col("feed")
    base = F.coalesce(F.nullif(feed.base_url, F.lit("")), origin(feed.url), F.lit(""))
    patterns = F.filter(F.transform(feed.url_patterns, strip), lambda p: p != "")
    staged = parsed.select(
        *keep, "links", "titles", base.alias("base"), F.coalesce(patterns, F.array().cast("array<string>")).alias("patterns")
    )

    def usable(link: Column) -> Column:
        href = F.lower(link.href)
        return (href != "") & ~href.startswith("#") & ~href.startswith("javascript:") & ~href.startswith("mailto:")

    def entry(link: Column) -> Column:
        url = F.when(F.col("base") != "", resolve_url(F.col("base"), link.href)).otherwise(link.href)
        return F.struct(
            link["at"].alias("at"),
            F.coalesce(F.nullif(link.node_title, F.lit("")), F.nullif(link.text, F.lit(""))).alias("title"),
            url.alias("url"),
        )

    numbered = F.transform(
        "links",
        lambda link, at: F.struct(
            at.alias("at"), strip(link.href).alias("href"), link.text.alias("text"), F.get("titles", at).alias("node_title")
        ),
    )
    # Worked out inside the array, so that each address is resolved once.
    entries = F.filter(
        F.transform(F.filter(numbered, usable), entry),
        lambda e: (F.size("patterns") == 0) | F.exists("patterns", lambda p: e.url.contains(p)),
    )
    return staged.select(*keep, F.explode_outer(entries).alias("entry")).filter(F.col("entry").isNotNull()).select(
        *keep, "entry.at", F.coalesce("entry.title", "entry.url").alias("title"), "entry.url"
    )
