"""Publication time out of page HTML."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.constants import META_DATE_KEYS, SCRIPT_DATE_KEYS
from gleaner.functions.html import linked_data_dates
from gleaner.functions.times import first_time

_TAG_REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag's text, null when absent."""
    pattern = rf"""(?is)[\s"']{name}\s*=\s*("([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    given = F.regexp_extract(tag, pattern, 1)
    return F.when(given != "", F.regexp_replace(given, r"""(?s)^["'](.*)["']$""", "$1"))


def _values_of_keys(html: Column, quote: str) -> Column:
    """Texts that stand in quotes after a known date key and a colon.

    The text is cut at the quoted keys; each part after a key starts with its value.
    """
    keys = "|".join(quote + key + quote for key in SCRIPT_DATE_KEYS).replace("\\", "\\\\")
    parts = F.split(html, keys)

    # the value ends at the next such quote
    value = r'^\s*:\s*"([^"]*+)' if quote == '"' else r'^\s*:\s*\\"((?:[^\\]++|\\(?!"))*+)'
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda part: F.regexp_extract(part, value, 1))


def script_time(html: Column) -> Column:
    """First parseable date next to a known key in script text, plain before escaped quoting."""
    return F.coalesce(first_time(_values_of_keys(html, '"')), first_time(_values_of_keys(html, '\\"')))


def _having(attribute: str, value: str) -> Callable[[Column], Column]:
    return lambda meta: meta[attribute] == value


def meta_fields(metas: Column) -> Column:
    """Attributes of meta tags that may carry a date."""
    return F.transform(
        metas,
        lambda m: F.struct(*[_attribute(m, name).alias(name) for name in ("property", "name", "itemprop", "content")]),
    )


def meta_time(fields: Column) -> Column:
    """By key in order of precedence: the content of the first tag with that key."""
    return first_time(
        F.array(
            *[
                F.try_element_at(F.filter(fields, _having(attribute, value)), F.lit(1))["content"]
                for attribute, value in META_DATE_KEYS
            ]
        )
    )


def time_tag_time(times: Column) -> Column:
    """First parseable ``<time>``: its datetime attribute, else its text."""
    value = F.transform(
        times,
        lambda t: F.coalesce(
            F.nullif(_attribute(F.regexp_extract(t, rf"(?is)^<time{_TAG_REST}>", 0), "datetime"), F.lit("")),
            F.regexp_replace(F.regexp_replace(t, rf"(?is)<[a-z/!]{_TAG_REST}>", ""), r"(?m)^\s+|\s+$", ""),
        ),
    )
    return first_time(value)


def _by(rule: str, time: Column) -> Column:
    """The time with the rule that found it; null when there is none."""
    named = F.transform(
        F.array(time), lambda t: F.when(t.isNotNull(), F.struct(F.lit(rule).alias("by"), t.alias("at")))
    )
    return F.get(named, F.lit(0))


def with_published_at(pages: DataFrame) -> DataFrame:
    """Add ``published_at`` (and ``published_by``, the rule that found it).

    Order: meta tags, JSON-LD, dates in script text, time tags.  Pages are
    scanned with column expressions; only the JSON-LD blocks, if any, go to a
    Python worker.
    """
    clean = F.regexp_replace("html", r"(?s)<!--.*?-->", "")
    markup = F.regexp_replace("_clean", r"(?is)<(script|style)\b.*?</\1\s*>", "")
    blocks = F.regexp_extract_all(
        "_clean",
        F.lit(r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script"""),
        F.lit(1),
    )
    staged = (
        pages.withColumn("_clean", clean)
        .withColumns({"_markup": markup, "_blocks": F.nullif(blocks, F.array().cast("array<string>"))})
        .withColumns(
            {
                "_metas": meta_fields(F.regexp_extract_all("_markup", F.lit(rf"(?is)<meta\b{_TAG_REST}>"), F.lit(0))),
                "_times": F.regexp_extract_all("_markup", F.lit(rf"(?is)<time\b{_TAG_REST}>.*?</time\s*>"), F.lit(0)),
                "_linked": linked_data_dates("_blocks"),
            }
        )
    )
    # One expression, so that a later rule is tried only where the earlier failed.
    found = F.coalesce(
        _by("meta", meta_time(F.col("_metas"))),
        _by("json_ld", first_time(F.col("_linked"))),
        _by("script", script_time(F.col("html"))),
        _by("time_tag", time_tag_time(F.col("_times"))),
    )
    return (
        staged.withColumn("_found", found)
        .withColumns({"published_at": F.col("_found.at"), "published_by": F.col("_found.by")})
        .select(*pages.columns, "published_at", "published_by")
    )
