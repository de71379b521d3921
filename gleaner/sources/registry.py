"""Source registry: reading, validation, feed addresses, manual candidates."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleaner.constants import FEED_TYPES, SOURCE_DISPLAYS
from gleaner.functions.text import non_blank, strip
from gleaner.functions.times import parse_datetime
from gleaner.functions.urls import has_http_scheme, is_http_url
from gleaner.schemas import FEED, MANUAL_URL

_RAW_FEED = FEED.replace("params:map<string,string>", "params:string")
_RAW_SOURCE = (
    "struct<name:string,enabled:boolean,display:string,feed:string,site_url:string,"
    "tags:array<string>,manual_urls:array<string>>"
)
SOURCE_KEYS = ["name", "enabled", "display", "feed", "site_url", "tags", "manual_urls"]
FEED_KEYS = [
    "type", "url", "route", "instance", "params", "link_selector", "title_selector", "url_patterns", "base_url",
]


@F.pandas_udf(StringType())
def _yaml_as_json(text: pd.Series) -> pd.Series:
    import yaml

    return text.map(lambda t: json.dumps(yaml.safe_load(t) or {}, ensure_ascii=False, default=lambda d: d.isoformat()))


def _manual_item(item: Column) -> Column:
    """A bare string is an address; an object is read with its fields."""
    fields = F.from_json(item, MANUAL_URL)
    bare = F.struct(
        item.alias("url"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("published_at"),
        F.array().cast("array<string>").alias("tags"),
    )
    return F.when(strip(item).startswith("{"), fields).otherwise(bare)


def _params(raw: Column) -> Column:
    """Parameter values as text; booleans are written ``True`` and ``False``."""
    values = F.from_json(raw, "map<string,variant>")
    return F.transform_values(
        values,
        lambda _, v: F.when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(v.cast("string"))).otherwise(v.cast("string")),
    )


def _unknown_keys(raw: Column, allowed: list[str]) -> Column:
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    return F.array_except(keys, F.array(*[F.lit(k) for k in allowed]))


def parse_registry(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split registry documents (one JSON text per row) into sources and manual URLs.

    Returns the sources (schema ``SOURCES`` plus ``unknown_keys``) and the
    top-level manual URLs.
    """
    top = documents.select(
        F.from_json("value", "sources array<string>, manual_urls array<string>").alias("r")
    ).select("r.*")
    source = F.from_json("raw", _RAW_SOURCE)
    feed = F.from_json(F.col("s.feed"), _RAW_FEED)
    empty = F.array().cast("array<string>")
    sources = (
        top.select(F.posexplode("sources").alias("position", "raw"))
        .withColumn("s", source)
        .withColumn("f", F.when(F.col("s.feed").isNotNull(), feed))
        .select(
            "position",
            F.col("s.name").alias("name"),
            F.coalesce("s.enabled", F.lit(True)).alias("enabled"),
            F.coalesce("s.display", F.lit("default")).alias("display"),
            F.when(
                F.col("f").isNotNull(),
                F.struct(
                    "f.type", "f.url", "f.route", "f.instance",
                    F.coalesce(_params(F.col("f.params")), F.create_map().cast("map<string,string>")).alias("params"),
                    "f.link_selector", "f.title_selector",
                    F.coalesce("f.url_patterns", empty).alias("url_patterns"),
                    "f.base_url",
                ),
            ).alias("feed"),
            F.col("s.site_url").alias("site_url"),
            F.coalesce("s.tags", empty).alias("tags"),
            F.transform(F.coalesce("s.manual_urls", empty), _manual_item).alias("manual_urls"),
            F.concat(
                _unknown_keys(F.col("raw"), SOURCE_KEYS), _unknown_keys(F.col("s.feed"), FEED_KEYS)
            ).alias("unknown_keys"),
        )
    )
    manual = top.select(F.posexplode("manual_urls").alias("position", "raw")).select(
        "position", _manual_item(F.col("raw")).alias("m")
    ).select("position", "m.*")
    return sources, manual


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read registry files (JSON, or YAML where PyYAML is installed)."""
    documents = spark.read.text(path, wholetext=True)
    if path.rstrip("/").endswith((".yaml", ".yml")):
        try:
            import yaml  # noqa: F401
        except ImportError as missing:
            raise RuntimeError("reading YAML registries needs PyYAML; use JSON instead") from missing
        documents = documents.select(_yaml_as_json("value").alias("value"))
    return parse_registry(documents)


def enabled_feeds(sources: DataFrame) -> DataFrame:
    """Sources that take part in discovery."""
    return sources.filter(F.col("enabled") & F.col("feed").isNotNull())


def manual_candidates(sources: DataFrame, manual: DataFrame, ordinal_base: int = 1 << 56) -> DataFrame:
    """Manually listed URLs as entries, after all feed entries in the order of the batch.

    Top-level URLs belong to the source ``manual``; those of a source count only
    while it is enabled and carry the tags of both.
    """
    top = manual.select(
        F.lit("manual").alias("source_name"),
        F.col("position").cast("bigint").alias("ordinal"),
        "url", "title", "published_at",
        F.col("tags").alias("source_tags"),
    )
    listed = (
        sources.filter("enabled")
        .select("position", "name", F.col("tags").alias("own_tags"), F.posexplode("manual_urls").alias("at", "m"))
        .select(
            F.col("name").alias("source_name"),
            ((F.col("position").cast("bigint") + 1) * F.lit(1 << 32) + F.col("at")).alias("ordinal"),
            F.col("m.url").alias("url"),
            F.col("m.title").alias("title"),
            F.col("m.published_at").alias("published_at"),
            F.concat("own_tags", F.coalesce("m.tags", F.array().cast("array<string>"))).alias("source_tags"),
        )
    )
    return top.unionByName(listed).select(
        "source_name",
        (F.col("ordinal") + F.lit(ordinal_base)).alias("ordinal"),
        F.coalesce(F.nullif("title", F.lit("")), F.col("url")).alias("title"),
        "url",
        parse_datetime(F.col("published_at")).alias("published_at"),
        F.coalesce("source_tags", F.array().cast("array<string>")).alias("source_tags"),
        F.lit(None).cast("string").alias("source_content"),
        F.lit(None).cast("map<string,string>").alias("source_content_metadata"),
    )


def _form_encoded(value: Column) -> Column:
    """Form encoding with ``~`` kept and ``*`` escaped."""
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def with_feed_url(
    sources: DataFrame,
    rsshub_instance: str,
    rsshub_enabled: bool = True,
    listing_enabled: bool = True,
) -> DataFrame:
    """Add ``feed_url`` and, where a kind of feed is switched off, ``feed_error``."""
    feed = F.col("feed")
    base = F.regexp_replace(F.coalesce(F.nullif(feed.instance, F.lit("")), F.lit(rsshub_instance)), "/+$", "")
    query = F.array_join(
        F.transform(F.map_entries(feed.params), lambda p: F.concat(_form_encoded(p.key), F.lit("="), _form_encoded(p.value))),
        "&",
    )
    hub = F.concat(base, F.coalesce(feed.route, F.lit("")), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    kind = feed.type
    error = (
        F.when(feed.isNull(), F.lit("source feed is required"))
        .when((kind == "listing") & (not listing_enabled), F.lit("listing is disabled"))
        .when((kind == "rsshub") & (not rsshub_enabled), F.lit("rsshub is disabled"))
        .when(~kind.isin(FEED_TYPES), F.concat(F.lit("unsupported feed type: "), kind))
    )
    url = F.when(kind == "rsshub", hub).otherwise(F.coalesce(feed.url, F.lit("")))
    return sources.withColumn("feed_error", error).withColumn("feed_url", F.when(error.isNull(), url))


def with_violations(sources: DataFrame) -> DataFrame:
    """Add ``violations``: the codes of every registry rule a source breaks."""
    feed = F.col("feed")
    kind = feed.type
    has_feed = feed.isNotNull()
    by_url = kind.isin("direct", "sitemap", "listing")
    route = feed.route
    bad_route = ~route.startswith("/") | route.startswith("//") | route.contains("#")

    def rule(broken: Column, code: str) -> Column:
        return F.when(F.coalesce(broken, F.lit(False)), F.lit(code))

    rules = [
        rule(non_blank(F.col("name")).isNull(), "name is required"),
        rule(~F.col("display").isin(SOURCE_DISPLAYS), "display is unknown"),
        rule(has_feed & (kind.isNull() | ~kind.isin(FEED_TYPES)), "feed.type is unknown"),
        rule(has_feed & by_url & (F.coalesce(feed.url, F.lit("")) == ""), "feed.url is required"),
        rule(by_url & (feed.url != "") & ~is_http_url(feed.url), "feed.url must be an http or https URL"),
        rule(has_feed & (kind == "rsshub") & (F.coalesce(route, F.lit("")) == ""), "feed.route is required"),
        rule((kind == "rsshub") & (route != "") & bad_route, "feed.route must be an absolute path"),
        rule(has_feed & (kind == "listing") & non_blank(feed.link_selector).isNull(), "feed.link_selector is required"),
        rule((kind == "listing") & feed.base_url.isNotNull() & ~is_http_url(feed.base_url),
             "feed.base_url must be an http or https URL"),
        rule((feed.instance != "") & ~is_http_url(feed.instance), "feed.instance must be an http or https URL"),
        rule(F.exists(F.map_keys(feed.params), lambda k: strip(k) == ""), "feed.params keys must not be empty"),
        rule((F.col("site_url") != "") & ~has_http_scheme(F.col("site_url")), "site_url has an unsupported scheme"),
        rule(F.exists("manual_urls", lambda m: ~has_http_scheme(m.url)), "manual_urls has an unsupported scheme"),
    ]
    if "unknown_keys" in sources.columns:
        rules.append(rule(F.size("unknown_keys") > 0, "unknown keys"))
    return sources.withColumn("violations", F.array_compact(F.array(*rules)))

