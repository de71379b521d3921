"""Expressions for published text: descriptions, labels, documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.constants import (
    CONTENT_TYPE_LABELS,
    ORIGINAL_LINK_PREFIX,
    SOURCE_BLOCK_LABELS,
    SOURCE_BLOCK_TITLE,
    UNKNOWN_TIME,
)
from gleaner.functions.text import non_blank, strip
from gleaner.functions.times import iso_z


def content_type_label(content_type: Column) -> Column:
    labels = F.create_map(*[F.lit(part) for pair in CONTENT_TYPE_LABELS.items() for part in pair])
    return F.try_element_at(labels, content_type)


def description(summary: Column, reason: Column, url: Column) -> Column:
    """Summary, reason and original link as paragraphs; blank parts are left out."""
    parts = F.array(non_blank(summary), non_blank(reason), F.concat(F.lit(ORIGINAL_LINK_PREFIX), url))
    return F.array_join(F.array_compact(parts), "\n\n")


def article_url(base_url: str, slug: Column) -> Column:
    return F.concat(F.lit(base_url.rstrip("/") + "/api/public/articles/"), slug)


def yaml_scalar(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('\\"')), F.lit('"'))


def front_matter(title: Column, url: Column, source: Column, content_type: Column, published_at: Column,
                 collected_at: Column, tags: Column) -> Column:
    def line(name: str, value: Column) -> list[Column]:
        return [F.lit(f"{name}: "), yaml_scalar(value), F.lit("\n")]

    blank = F.lit("")
    return F.concat(
        F.lit("---\n"),
        *line("title", title),
        *line("url", url),
        *line("source", source),
        *line("content_type", content_type),
        *line("published_at", F.coalesce(iso_z(published_at), blank)),
        *line("collected_at", F.coalesce(iso_z(collected_at), blank)),
        F.lit("tags:\n"),
        F.array_join(F.transform(tags, lambda t: F.concat(F.lit("  - "), yaml_scalar(t))), "\n"),
        F.lit("\n---\n\n"),
    )


def source_block(source: Column, url: Column, published_at: Column, fetched_at: Column) -> Column:
    values = [source, url, F.coalesce(iso_z(published_at), F.lit(UNKNOWN_TIME)), iso_z(fetched_at)]
    lines = [part for label, value in zip(SOURCE_BLOCK_LABELS, values) for part in (F.lit(f"\n> - {label}："), value)]
    return F.concat(F.lit(f"> {SOURCE_BLOCK_TITLE}\n>"), *lines, F.lit("\n\n"))


def document(matter: Column, block: Column, content: Column) -> Column:
    return F.concat(matter, block, strip(content), F.lit("\n"))
