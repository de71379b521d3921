"""URL expressions, all on the JVM side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.constants import LOCAL_HOSTS
from gleaner.functions.text import strip

_HEAD = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]+"
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def _head(url: Column) -> Column:
    return F.regexp_extract(url, _HEAD, 0)


def _tail(url: Column) -> Column:
    """Path, query and fragment, without an empty ``?`` or ``#``."""
    rest = F.substr(url, F.length(_head(url)) + 1)
    return F.regexp_replace(F.regexp_replace(rest, r"^([^?#]*)\?(#|$)", "$1$2"), r"^([^#]*)#$", "$1")


def normalize_url(url: Column) -> Column:
    """Lower scheme and host and drop the scheme's default port; keep the rest.

    Text without a host is only trimmed.
    """
    text = strip(url)
    head = F.lower(_head(text))
    head = F.when(head.startswith("//"), F.concat(F.lit("https:"), head)).otherwise(head)
    head = F.regexp_replace(head, r"^(http://.*):80$|^(https://.*):443$", "$1$2")
    return F.when(text.rlike(_HEAD), F.concat(head, _tail(text))).otherwise(text)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def host(url: Column) -> Column:
    """Host name without user and port, lowered."""
    netloc = F.regexp_extract(_head(url), r"//(.*)$", 1)
    return F.lower(F.regexp_extract(netloc, r"^(?:.*@)?([^:]*)", 1))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+", 0)


def is_http_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))


def has_http_scheme(url: Column) -> Column:
    return scheme(url).isin("http", "https")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Name an intermediate value, so that the expression does not repeat it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _without_dots(segments: Column) -> Column:
    """Resolve ``.`` and ``..`` in a split path and join it again."""
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == ".", acc)
        .when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, seg)),
    )
    ends_in_dot = F.element_at(segments, -1).isin(".", "..")
    return F.concat(
        F.array_join(kept, "/"),
        F.when(ends_in_dot & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")),
    )


def _merged_path(base_path: Column, path: Column) -> Column:
    """Path of a reference below a base path."""

    def folder(parts: Column) -> Column:
        keep = F.size(parts) - (F.element_at(parts, -1) != "").cast("int")
        return F.slice(parts, F.lit(1), F.greatest(keep, F.lit(0)))

    def without_inner_blanks(parts: Column) -> Column:
        last = F.size(parts) - 1
        return F.filter(parts, lambda part, at: (part != "") | (at == 0) | (at == last))

    below = _let(
        F.concat(_let(F.split(base_path, "/"), folder), F.split(path, "/")), without_inner_blanks
    )
    segments = F.when(path.startswith("/"), F.split(path, "/")).otherwise(below)
    return _let(
        _let(segments, _without_dots),
        lambda joined: F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined)),
    )


def resolve_url(base: Column, ref: Column) -> Column:
    """Resolve a reference against a base URL (RFC 3986, empty inner segments dropped)."""
    base_head, ref_scheme = _head(base), scheme(ref)
    base_rest = F.regexp_extract(base, _HEAD + r"([^#]*)", 1)
    base_path = F.regexp_extract(base, _HEAD + r"([^?#]*)", 1)
    local = F.regexp_replace(ref, _SCHEME, "")
    path = F.regexp_extract(local, r"^[^?#]*", 0)
    after_path = F.regexp_extract(local, r"^[^?#]*(.*)$", 1)
    return (
        F.when(ref == "", base)
        .when((ref_scheme != "") & (ref_scheme != scheme(base)), ref)
        .when(local.startswith("//"), F.concat(scheme(base), F.lit(":"), local))
        .when(path != "", F.concat(base_head, _merged_path(base_path, path), after_path))
        .when(after_path.startswith("?"), F.concat(base_head, base_path, after_path))
        .otherwise(F.concat(base_head, base_rest, after_path))
    )


def absolutise_entry_url(url: Column, site_url: Column, feed_url: Column) -> Column:
    """Make a feed entry's link fetchable.

    Absolute links stay, except that a development host is replaced by the
    site's; anything else is resolved against the site or else the feed.
    """
    link = strip(url)
    base = F.coalesce(F.nullif(site_url, F.lit("")), F.nullif(feed_url, F.lit("")))
    absolute = has_http_scheme(link)
    on_site = F.concat(origin(base), _tail(link))
    return (
        F.when(base.isNull(), link)
        .when(absolute & host(link).isin(LOCAL_HOSTS) & (origin(base) != ""), on_site)
        .when(absolute, link)
        .otherwise(resolve_url(base, link))
    )
