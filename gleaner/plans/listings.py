"""Listings and details over the state tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.constants import SORT_COLUMNS
from gleaner.functions.times import item_time
from gleaner.operators import latest as newest
from gleaner.operators.filters import by_source, by_status, failed_only as only_failed, matching, published_between
from gleaner.operators.latest import with_latest_content
from gleaner.operators.membership import id_bitmaps, possibly_in
from gleaner.operators.tags import with_public_tags
from gleaner.plans.paging import Order, cursor_envelope, cursor_page, ordering
from gleaner.session import written

_LISTED = ["id", "title", "url", "source_name", "status", "retry_count", "published_at", "created_at", "updated_at",
           "collected_at"]


def page_values(page: int, page_size: int) -> tuple[int, int]:
    """Page from 1 on and a page size from 1 on, as asked for."""
    return max(1, page), max(1, page_size)


def paged(frame: DataFrame, page: int, page_size: int) -> DataFrame:
    page, page_size = page_values(page, page_size)
    return frame.offset((page - 1) * page_size).limit(page_size)


def of_page(log: DataFrame, page: DataFrame) -> DataFrame:
    """Log rows of the listed articles.

    The ids of a page are few; Spark broadcasts them below its size limit, and then
    filters the logs where they are read.
    """
    return log.join(page.select(F.col("id").alias("article_id")), "article_id", "left_semi")


def article_filter(
    articles: DataFrame,
    *,
    status: str | None = None,
    source: str | None = None,
    q: str | None = None,
    since: str | None = None,
    until: str | None = None,
    logs: tuple[DataFrame, DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """All filters of the listing; ``logs`` (fetches, evaluations, failures) asks for failures only."""
    frame = by_source(by_status(articles, status), source)
    frame = published_between(matching(frame, q, "title", "url", "source_name"), since, until)
    return only_failed(frame, *logs) if logs else frame


def listing_keys(sort: str, order: str) -> Order:
    """A known sort column (else the update time) and the id, in one direction."""
    column, ascending = sort if sort in SORT_COLUMNS else "updated_at", order.lower() == "asc"
    return [(column, ascending), ("id", ascending)]


def listing_order(sort: str, order: str) -> list[Column]:
    return ordering(listing_keys(sort, order))


def article_page(
    articles: DataFrame,
    fetches: DataFrame,
    evaluations: DataFrame,
    failures: DataFrame,
    history: DataFrame,
    *,
    page: int = 1,
    page_size: int = 50,
    sort: str = "updated_at",
    order: str = "desc",
    failed_only: bool = False,
    cursor: Mapping[str, object] | None = None,
    **filters: str | None,
) -> DataFrame:
    """One page of articles with the latest outcome of every stage.

    The page is cut and written first; only then are the logs looked at, and only for
    its ids.  With a ``cursor`` (sort value and id of the last row before) the page
    follows it, and ``page`` isn't looked at.
    """
    logs = (fetches, evaluations, failures) if failed_only else None
    chosen = article_filter(articles, logs=logs, **filters).select(*_LISTED)
    keys = listing_keys(sort, order)
    cut = cursor_page(chosen, keys, page_size, cursor) if cursor else paged(chosen.orderBy(*ordering(keys)), page, page_size)
    rows = written(cut, "page")
    fetch = newest.latest(of_page(fetches, rows), "article_id", "status", "error")
    evaluation = newest.latest(of_page(evaluations, rows), "article_id", "decision")
    failure = newest.latest(of_page(failures, rows), "article_id", "error")
    stages = newest.stage_status(of_page(history, rows))
    joined = rows
    for facts, renames in (
        (stages, {}),
        (fetch, {"status": "fetch_status", "error": "fetch_error"}),
        (evaluation, {"decision": "evaluation_status"}),
        (failure, {"error": "evaluation_error"}),
    ):
        facts = facts.withColumnsRenamed({**renames, "article_id": "_of"})
        joined = joined.join(facts, joined.id == facts._of, "left").drop("_of")
    return joined.orderBy(*listing_order(sort, order))


def page_envelope(items: DataFrame, filtered: DataFrame, page: int, page_size: int) -> DataFrame:
    """Items, total, page, page size and whether there is a next page, in one row.

    ``items`` is one page, so the list is bounded by the page size.
    """
    page, page_size = page_values(page, page_size)
    total = filtered.agg(F.count(F.lit(1)).alias("total")).scalar()
    rows = items.agg(F.collect_list(F.struct(*items.columns)).alias("items"))
    return rows.withColumn("total", total).select(
        "items", "total", F.lit(page).alias("page"), F.lit(page_size).alias("page_size"),
        (F.lit(page * page_size) < F.col("total")).alias("has_next"),
    )


def _public_rows(articles: DataFrame, q: str | None) -> DataFrame:
    accepted = matching(by_status(articles, "accepted"), q, "title", "url", "source_name")
    return accepted.select(
        "id", "slug", "title", "url", F.col("source_name").alias("source"), "status", "published_at", "collected_at",
        "created_at", "updated_at",
    )


def _with_verdict(rows: DataFrame, evaluations: DataFrame) -> DataFrame:
    verdict = newest.latest(
        evaluations, "article_id", "summary", "content_type", "recommendation_reason"
    ).withColumnRenamed("article_id", "_of")
    return rows.join(verdict, rows.id == verdict._of, "left").drop("_of")


PUBLIC_KEYS: Order = [("item_time", False), ("id", False)]


def public_page(
    articles: DataFrame, evaluations: DataFrame, links: DataFrame, vocabulary: DataFrame,
    *, page: int = 1, page_size: int = 50, q: str | None = None, cursor: Mapping[str, object] | None = None,
) -> DataFrame:
    """One page of accepted articles, newest first, with verdict and tags (both optional).

    A ``cursor`` has ``item_time`` and ``id`` of the last row before.
    """
    chosen = _public_rows(articles, q).withColumn("item_time", item_time())
    cut = cursor_page(chosen, PUBLIC_KEYS, page_size, cursor) if cursor else paged(chosen.orderBy(*ordering(PUBLIC_KEYS)), page, page_size)
    rows = written(cut, "public-page")
    full = _with_verdict(rows, of_page(evaluations, rows))
    return with_public_tags(full, of_page(links, rows), vocabulary).orderBy(*ordering(PUBLIC_KEYS)).drop("item_time")


def public_index(
    articles: DataFrame, evaluations: DataFrame, links: DataFrame, vocabulary: DataFrame, *, q: str | None = None
) -> DataFrame:
    """All accepted articles, newest first."""
    rows = _with_verdict(_public_rows(articles, q), evaluations)
    return with_public_tags(rows, links, vocabulary).orderBy(F.desc(item_time()), F.desc("id"))


def public_detail(
    articles: DataFrame, fetches: DataFrame, evaluations: DataFrame, links: DataFrame, vocabulary: DataFrame,
    slug: str | DataFrame | None = None,
) -> DataFrame:
    """Accepted articles by slug with content, verdict and tags.

    Unlike publishing, an article without fetch or verdict is shown.  ``slug``
    may be one slug, a frame of slugs, or nothing for all.  The articles are chosen
    on ids and slugs alone; bitmaps of their ids filter articles and logs where they
    are read, and everything meets by article id, once.
    """
    accepted = by_status(articles, "accepted").drop("source_content", "source_content_metadata")
    if isinstance(slug, DataFrame):
        chosen = accepted.select("id", "slug").join(slug.select("slug").distinct(), "slug", "left_semi")
    else:
        chosen = accepted if slug is None else accepted.filter(F.col("slug") == slug)
    chosen = written(chosen.select("id"), "chosen-articles")
    marks = id_bitmaps(chosen, "id")
    rows = possibly_in(accepted, "id", marks).join(chosen, "id", "left_semi").select(*accepted.columns)
    fetches, evaluations, links = (possibly_in(log, "article_id", marks) for log in (fetches, evaluations, links))
    return with_latest_content(with_public_tags(_with_verdict(rows, evaluations), links, vocabulary), fetches, how="left")


def article_detail(
    articles: DataFrame, fetches: DataFrame, evaluations: DataFrame, failures: DataFrame, history: DataFrame,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Articles with their latest log rows nested and the last ten stage rows as a list."""
    if ids is not None:
        chosen = ids.select("id").distinct()
        articles = articles.join(chosen, "id", "left_semi")
        keys = chosen.withColumnRenamed("id", "article_id")
        fetches, evaluations, failures, history = (
            log.join(keys, "article_id", "left_semi") for log in (fetches, evaluations, failures, history)
        )
    result = articles.select(F.col("id").alias("article_id"), F.struct(*articles.columns).alias("article"))
    for log, name in ((fetches, "latest_fetch"), (evaluations, "latest_evaluation"), (failures, "latest_evaluation_failure")):
        last = newest.latest_rows(log, "article_id")
        result = result.join(last.select("article_id", F.struct(*log.columns).alias(name)), "article_id", "left")
    recent = newest.last_n(history, "article_id", 10)
    queue = recent.groupBy("article_id").agg(
        F.array_sort(F.collect_list(F.struct("recency", *history.columns))).alias("queue")
    )
    return result.join(queue, "article_id", "left").withColumn(
        "queue", F.coalesce("queue", F.array().cast(queue.schema["queue"].dataType))
    )


TAG_KEYS: Order = [("status", True), ("name_key", True), ("name", True), ("id", True)]
CANDIDATE_KEYS: Order = [("created_at", False), ("id", False)]


def tag_rows(vocabulary: DataFrame, links: DataFrame, *, status: str | None = None, q: str | None = None) -> DataFrame:
    """Vocabulary entries with their article counts, by status and case-insensitive name, and ``name_key`` to order by."""
    counts = links.groupBy(F.col("tag_id").alias("_tag")).agg(F.count(F.lit(1)).alias("article_count"))
    chosen = matching(by_status(vocabulary, status), q, "name", "description").withColumn("name_key", F.lower("name"))
    return chosen.join(counts, chosen.id == counts._tag, "left").drop("_tag").withColumn("article_count", F.coalesce("article_count", F.lit(0)))


def tag_page(
    vocabulary: DataFrame, links: DataFrame, *, status: str | None = None, q: str | None = None, limit: int = 200,
    offset: int = 0, cursor: Mapping[str, object] | None = None,
) -> DataFrame:
    """One page of ``tag_rows``; a ``cursor`` has the values of ``TAG_KEYS``."""
    rows = tag_rows(vocabulary, links, status=status, q=q)
    cut = cursor_page(rows, TAG_KEYS, limit, cursor) if cursor else rows.orderBy(*ordering(TAG_KEYS)).offset(offset).limit(limit)
    return cut.drop("name_key")


def candidate_page(
    candidates: DataFrame, articles: DataFrame, *, status: str | None = "pending", limit: int = 100, offset: int = 0,
    cursor: Mapping[str, object] | None = None,
) -> DataFrame:
    """Tag candidates with their articles, newest first.

    A candidate always belongs to a stored article, so the page is cut first and
    only its articles are looked up.  A ``cursor`` has ``created_at`` and ``id``.
    """
    chosen = by_status(candidates, status)
    page = cursor_page(chosen, CANDIDATE_KEYS, limit, cursor) if cursor else chosen.orderBy(*ordering(CANDIDATE_KEYS)).offset(offset).limit(limit)
    known = articles.select(
        F.col("id").alias("article_id"), F.col("title").alias("article_title"), F.col("url").alias("article_url"),
        F.col("status").alias("article_status"),
    )
    return page.join(known, "article_id").orderBy(*ordering(CANDIDATE_KEYS))


def tag_listing(vocabulary: DataFrame, links: DataFrame, *, status: str | None = None, q: str | None = None, limit: int = 200,
                cursor: Mapping[str, object] | None = None) -> DataFrame:
    """One page of vocabulary entries with the total of all and the cursor of the next page, in one row."""
    page = cursor_page(tag_rows(vocabulary, links, status=status, q=q), TAG_KEYS, limit, cursor)
    return cursor_envelope(page, matching(by_status(vocabulary, status), q, "name", "description"), TAG_KEYS)


def candidate_listing(candidates: DataFrame, articles: DataFrame, *, status: str | None = "pending", limit: int = 100,
                      cursor: Mapping[str, object] | None = None) -> DataFrame:
    """One page of tag candidates with the total of all and the cursor of the next page, in one row."""
    page = candidate_page(candidates, articles, status=status, limit=limit, cursor=cursor)
    return cursor_envelope(page, by_status(candidates, status), CANDIDATE_KEYS)
