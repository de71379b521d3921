"""RSS and Atom bodies to entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.charsets import with_body_text
from gleaner.functions.html import first_text
from gleaner.functions.text import non_blank
from gleaner.functions.times import first_time
from gleaner.functions.urls import absolutise_entry_url

_TEXT = "array<struct<_VALUE:string,_type:string>>"
_ITEM = (
    f"struct<title:{_TEXT},"
    "link:array<struct<_VALUE:string,_href:string,_rel:string,_type:string>>,"
    "guid:array<struct<_VALUE:string,_isPermaLink:string>>,"
    "pubDate:array<string>,published:array<string>,issued:array<string>,"
    "updated:array<string>,modified:array<string>,`dc:date`:array<string>,"
    f"description:{_TEXT},summary:{_TEXT},`content:encoded`:array<string>,content:{_TEXT}>"
)
_FEED = f"channel struct<item:array<{_ITEM}>>, item array<{_ITEM}>, entry array<{_ITEM}>, _bad string"
_XML = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}


def strip_control_chars(body: Column) -> Column:
    """Drop the control characters XML forbids (tab and line ends stay)."""
    return F.regexp_replace(body, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def parse_feeds(bodies: DataFrame) -> DataFrame:
    """Add ``items`` and ``parse_error`` to rows with an XML ``body``.

    A broken body gives an error in its own row and never fails the job.
    """
    parsed = with_body_text(bodies).withColumn("_doc", F.from_xml(strip_control_chars(F.col("_text")), _FEED, _XML))
    items = F.coalesce("_doc.channel.item", "_doc.item", "_doc.entry", F.array().cast(f"array<{_ITEM}>"))
    broken = F.col("_text").isNull() | F.col("_doc._bad").isNotNull()
    return parsed.select(
        *bodies.columns,
        F.when(broken, F.lit("feed parse failed")).alias("parse_error"),
        F.when(~broken, items).alias("items"),
    )


def _link(item: Column) -> Column:
    """Text link, alternate link or permanent guid."""
    page_links = F.filter(
        item.link,
        lambda l: F.coalesce(l._rel, F.lit("alternate")).isin("alternate")
        & F.coalesce(l._type, F.lit("text/html")).isin("text/html", "application/xhtml+xml"),
    )
    texts = F.transform(page_links, lambda l: non_blank(F.coalesce(l._VALUE, l._href)))
    guid = F.filter(item.guid, lambda g: F.coalesce(F.lower(g._isPermaLink), F.lit("true")) == "true")
    return F.coalesce(
        F.try_element_at(F.array_compact(texts), F.lit(1)),
        F.try_element_at(F.transform(guid, lambda g: non_blank(g._VALUE)), F.lit(1)),
    )


def _first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def _value(parts: Column) -> Column:
    return non_blank(_first(F.transform(parts, lambda p: p._VALUE)))


def _content_type(declared: Column) -> Column:
    return (
        F.when(declared.isNull() | (declared == "text"), F.lit("text/plain"))
        .when(declared == "html", F.lit("text/html"))
        .when(declared == "xhtml", F.lit("application/xhtml+xml"))
        .otherwise(declared)
    )


def feed_entries(parsed: DataFrame) -> DataFrame:
    """Explode parsed feeds to entries.

    Needs ``position, source_name, source_tags, site_url, feed_url`` beside the
    parsed columns.  Entries without a link are dropped; the title falls back to
    the link.  Content is the first content element with text, else the summary.
    """
    item = F.col("item")
    # Broken bodies have no items.  The outer form keeps Spark from testing the
    # items below the explode, which would parse every body again.
    exploded = parsed.select(
        "position", "source_name", "source_tags", "site_url", "feed_url", F.posexplode_outer("items").alias("at", "item")
    ).filter(item.isNotNull())
    encoded = F.transform(
        item["content:encoded"], lambda v: F.struct(v.alias("text"), F.lit("text/html").alias("type"))
    )
    elements = F.transform(
        item.content, lambda c: F.struct(c._VALUE.alias("text"), _content_type(c._type).alias("type"))
    )
    none = F.array().cast("array<struct<text:string,type:string>>")
    contents = F.filter(
        F.concat(F.coalesce(encoded, none), F.coalesce(elements, none)), lambda c: non_blank(c.text).isNotNull()
    )
    fields = exploded.select(
        "position", "source_name", "source_tags", "site_url", "feed_url", "at",
        _link(item).alias("link"),
        _value(item.title).alias("title"),
        first_time(
            F.array(
                *[
                    _first(item[name])
                    for name in ("pubDate", "published", "issued", "updated", "modified", "dc:date")
                ]
            )
        ).alias("published_at"),
        contents.alias("contents"),
        F.coalesce(_value(item.summary), _value(item.description)).alias("summary"),
    ).filter(F.col("link").isNotNull())

    none_text = F.array().cast("array<string>")
    texts = F.concat(
        F.transform("contents", lambda c: c.text),
        F.when(F.col("summary").isNotNull(), F.array("summary")).otherwise(none_text),
    )
    staged = fields.withColumn("texts", texts).withColumn("lead", non_blank(_first(F.col("texts"))))
    lead = F.col("lead")
    staged = staged.withColumn("plain", ~(lead.contains("<") & lead.contains(">")))
    plain = F.col("plain")
    # Only rows that hold markup travel to the Python worker.
    chosen = staged.withColumn("picked", first_text(F.when(F.coalesce(~plain, F.lit(False)), F.col("texts"))))
    at = F.when(plain, F.lit(0)).otherwise(F.col("picked.at"))
    content = F.when(plain, lead).otherwise(F.col("picked.text"))
    of_content = at < F.size("contents")
    metadata = F.when(
        of_content,
        F.create_map(
            F.lit("source"), F.lit("feed_entry"), F.lit("field"), F.lit("content"),
            F.lit("content_type"), F.try_element_at(F.transform("contents", lambda c: c.type), at + 1),
        ),
    ).when(
        content.isNotNull(),
        F.create_map(F.lit("source"), F.lit("feed_entry"), F.lit("field"), F.lit("summary")),
    )
    return chosen.select(
        "source_name",
        (F.col("position").cast("bigint") * F.lit(1 << 32) + F.col("at")).alias("ordinal"),
        F.coalesce("title", "link").alias("title"),
        absolutise_entry_url(F.col("link"), F.col("site_url"), F.col("feed_url")).alias("url"),
        "published_at",
        "source_tags",
        content.alias("source_content"),
        metadata.alias("source_content_metadata"),
    )
