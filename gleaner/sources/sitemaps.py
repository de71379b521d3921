"""Sitemap bodies to entries, with bounded expansion of sitemap indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.constants import MAX_SITEMAP_DEPTH, MAX_SITEMAP_FILES
from gleaner.functions.charsets import with_body_text
from gleaner.functions.text import non_blank
from gleaner.functions.times import parse_datetime
from gleaner.operators.ids import numbered
from gleaner.session import written

_SITEMAP = "url array<struct<loc:string,lastmod:string>>, sitemap array<struct<loc:string>>, _bad string"
_XML = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "ignoreNamespace": "true"}
_ROOT = r"(?s)\A\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<![^>]*>\s*)*<(?:[\w.\-]+:)?([\w.\-]+)"
# Roots are kept apart from other documents: two sources may name the same address.
_ROOT_KEY = "root of "
_LOCATION = "array<struct<loc:string,lastmod:string>>"


def parse_sitemaps(bodies: DataFrame) -> DataFrame:
    """Add ``root``, ``locations`` (url nodes, then sitemap nodes) and ``parse_error``."""
    text = F.col("_text")
    parsed = with_body_text(bodies).withColumn("_doc", F.from_xml(text, _SITEMAP, _XML)).withColumn(
        "root", F.regexp_extract(text, _ROOT, 1)
    )
    none = F.array().cast(_LOCATION)
    nested = F.transform(
        "_doc.sitemap", lambda s: F.struct(s.loc.alias("loc"), F.lit(None).cast("string").alias("lastmod"))
    )
    nodes = F.filter(
        F.concat(F.coalesce("_doc.url", none), F.coalesce(nested, none)), lambda n: non_blank(n.loc).isNotNull()
    )
    error = (
        F.when(F.col("_text").isNull() | F.col("_doc._bad").isNotNull(), F.lit("sitemap parse failed"))
        .when(~F.col("root").isin("urlset", "sitemapindex"), F.concat(F.lit("unsupported sitemap root: "), F.col("root")))
    )
    return parsed.select(
        *bodies.columns, "root", error.alias("parse_error"), F.when(error.isNull(), nodes).alias("locations")
    )


def sitemap_entries(parsed: DataFrame, *keep: str) -> DataFrame:
    """URLs of plain sitemaps; the address is also the title."""
    # See feed_entries for the outer form.
    urls = F.when(F.col("root") == "urlset", F.col("locations"))
    return parsed.select(*keep, F.posexplode_outer(urls).alias("at", "node")).filter(F.col("node").isNotNull()).select(
        *keep,
        "at",
        non_blank(F.col("node.loc")).alias("title"),
        non_blank(F.col("node.loc")).alias("url"),
        parse_datetime(F.col("node.lastmod")).alias("published_at"),
    )


def _documents_by_path(roots: DataFrame, pairs: DataFrame, max_depth: int, max_files: int | None) -> DataFrame:
    """Every document a source reaches, with its place in the walk as a path.

    A path holds the positions of the links that lead to a document, so the order of
    paths, a prefix first, is the order of a depth-first walk, and a document is first
    met on the smallest of its paths without a circle.  Each level goes on from the
    documents whose smallest path it found: a longer way round a circle is never
    smaller than the way to where it closes.  One level beyond the limit is kept to
    tell which source nests too deep.  What follows ``max_files`` others in the walk is
    never reached and is cut before the shuffle.
    """
    found = written(
        roots.select("source_name", F.concat(F.lit(_ROOT_KEY), F.col("source_name")).alias("url"), F.col("url").alias("root_url"),
                     F.array().cast("array<int>").alias("path")),
        "sitemap-level",
    )
    in_order = Window.partitionBy("source_name").orderBy("path")
    for depth in range(max_depth + 1):
        level = (
            found.filter(F.size("path") == depth).join(pairs, F.col("url") == F.col("parent"))
            .filter(F.col("child") != F.col("root_url"))
            .select("source_name", F.col("child").alias("url"), "root_url", F.concat("path", F.array("at")).alias("path"))
        )
        found = found.unionByName(level).groupBy("source_name", "url", "root_url").agg(F.min("path").alias("path"))
        if max_files is not None:
            found = found.withColumn("n", F.row_number().over(in_order)).filter(F.col("n") <= max_files + 1).drop("n")
        found = written(found, "sitemap-level")
        if found.filter(F.size("path") == depth + 1).isEmpty():
            break
    return found.select("source_name", "url", "path")


def expand_sitemaps(
    roots: DataFrame, documents: DataFrame, *keep: str, max_depth: int = MAX_SITEMAP_DEPTH, max_files: int | None = MAX_SITEMAP_FILES
) -> tuple[DataFrame, DataFrame]:
    """Expand sitemap indexes over a table of bodies.

    ``roots`` has ``source_name, url, body`` and the columns to ``keep``;
    ``documents`` has one ``body`` per ``url``.  Returns entries ``(source_name, visit, at,
    title, url, published_at)`` in visiting order, and ``(source_name, error)``
    per failed source.  A source fails as a whole at the first document of its walk that
    is missing, lies deeper than ``max_depth`` below the root, comes after ``max_files``
    others (the root counts; None for no limit) or can't be read, in this order of checks.

    Bodies are parsed once and written as narrow rows.  Documents are found level by
    level over (parent, child) pairs and ordered by their paths in ranges, so a source
    may have any number of them.
    """
    key = F.concat(F.lit(_ROOT_KEY), F.col("source_name"))
    bodies = documents.select("url", "body").unionByName(roots.select(key.alias("url"), "body"))
    known = written(parse_sitemaps(bodies).drop("body"), "sitemaps")
    pairs = (
        known.filter(F.col("parse_error").isNull() & (F.col("root") == "sitemapindex"))
        .select(F.col("url").alias("parent"), F.posexplode("locations").alias("at", "node"))
        .groupBy("parent", non_blank(F.col("node.loc")).alias("child"))
        .agg(F.min("at").alias("at"))
    )
    pairs = written(pairs, "sitemap-links")
    found = _documents_by_path(roots, pairs, max_depth, max_files)
    placed = numbered(found, ["source_name", "path"], F.lit(-1), "place")
    firsts = placed.groupBy("source_name").agg(F.min("place").alias("first"))
    status = known.select("url", F.lit(True).alias("there"), "parse_error")
    visit = (F.col("place") - F.col("first")).cast("int")
    error = (
        F.when(F.col("there").isNull(), F.concat(F.lit("sitemap document not found: "), F.col("url")))
        .when(F.size("path") > max_depth, F.concat(F.lit("sitemap nesting too deep: "), F.col("url")))
        .when(F.lit(False) if max_files is None else F.col("visit") >= max_files, F.lit("sitemap expansion limit exceeded"))
        .otherwise(F.col("parse_error"))
    )
    walked = (
        placed.join(firsts, "source_name").select("source_name", "url", "path", visit.alias("visit"))
        .join(status, "url", "left").select("source_name", "url", "visit", error.alias("error"))
    )
    walked = written(walked, "sitemap-walk")
    failed = walked.filter(F.col("error").isNotNull()).groupBy("source_name").agg(F.min_by("error", "visit").alias("error"))
    visits = walked.join(failed, "source_name", "left_anti").select("source_name", "url", "visit")
    if keep:
        visits = visits.join(roots.select("source_name", *keep), "source_name")
    entries = sitemap_entries(
        visits.join(known, "url").select("source_name", *keep, "visit", "root", "parse_error", "locations"),
        "source_name", *keep, "visit",
    )
    return entries, failed
