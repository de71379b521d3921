"""String expressions: trimming, slugs, tag names, sizes, JSON text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleaner.constants import SLUG_LENGTH, WHITESPACE


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def non_blank(value: Column) -> Column:
    """The trimmed text, or null when nothing is left."""
    return F.nullif(strip(value), F.lit(""))


@F.pandas_udf(StringType())
def nfkd(text: pd.Series) -> pd.Series:
    """Compatibility decomposition; Spark has no built-in for it."""
    return text.str.normalize("NFKD")


def slug_of_decomposed(text: Column) -> Column:
    runs = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "-")
    slug = F.btrim(runs, F.lit("-"))
    return F.when(slug == "", F.lit("article")).otherwise(slug)


def slugify(text: Column) -> Column:
    """Decompose, lower, turn runs of non-word characters into one hyphen."""
    return slug_of_decomposed(nfkd(text))


def short_hash(value: Column, length: int = 8) -> Column:
    return F.left(F.sha2(value, 256), F.lit(length))


def title_slug(source: Column, title: Column) -> Column:
    """``source-title`` slug, cut to the slug length without a dangling hyphen.

    A vertical tab never survives slugging, so one Python call serves both parts.
    """
    both = F.split(nfkd(F.concat(source, F.lit("\x0b"), title)), "\x0b", 2)
    base = F.concat(slug_of_decomposed(both[0]), F.lit("-"), slug_of_decomposed(both[1]))
    return F.when(
        F.length(base) > SLUG_LENGTH, F.rtrim(F.left(base, F.lit(SLUG_LENGTH)), F.lit("-"))
    ).otherwise(base)


def hashed_slug(base: Column, url: Column) -> Column:
    """The slug used when the plain one is taken."""
    return F.concat(base, F.lit("-"), short_hash(url))


def normalize_tag(name: Column) -> Column:
    return F.regexp_replace(strip(F.lower(name)), r"(?U)\s+", " ")


def tag_slug(name: Column) -> Column:
    return F.replace(normalize_tag(name), F.lit(" "), F.lit("-"))


def content_bytes(text: Column) -> Column:
    """Size in UTF-8, which is how Spark stores strings."""
    return F.octet_length(text)


def evaluator_input(text: Column, most_chars: int | None = None) -> Column:
    """The body handed to the evaluator: all of it, or its first characters where a limit is given.

    ``EVALUATOR_INPUT_CHARS`` is the limit that stored prompts were made with.
    """
    return text if most_chars is None else F.left(text, F.lit(most_chars))


def strip_fences(reply: Column) -> Column:
    """Remove a Markdown code fence around a reply."""
    text = strip(reply)
    opened = F.regexp_replace(text, r"\A```[^\r\n]*(?:\r\n|\r|\n|\z)", "")
    closed = F.regexp_replace(opened, r"(?:\A|(?<=[\r\n]))```[^\r\n]*\z", "")
    return F.when(text.startswith("```"), strip(closed)).otherwise(text)


def extract_json(reply: Column) -> Column:
    """The reply without fences when it is valid JSON, else null."""
    text = strip_fences(reply)
    return F.when(F.try_parse_json(text).isNotNull(), text)


def tag_list(json_text: Column) -> Column:
    """Lenient decode of a JSON list of tags; anything else is an empty list."""
    is_list = strip(json_text).startswith("[")
    decoded = F.when(is_list & F.try_parse_json(json_text).isNotNull(), F.from_json(json_text, "array<string>"))
    return F.filter(
        F.coalesce(decoded, F.array().cast("array<string>")), lambda t: strip(F.coalesce(t, F.lit("None"))) != ""
    )


def like_ascii(value: Column, needle: str) -> Column:
    """Substring match, ``%`` and ``_`` in the needle being wildcards.

    Only ASCII letters fold, so ``É`` and ``é`` stay different.
    """
    lower = UPPER.lower()
    pattern = "%" + needle.strip().translate(str.maketrans(UPPER, lower)).replace("\\", "\\\\") + "%"
    return F.translate(value, UPPER, lower).like(pattern)
