"""Fetch, evaluation and override logs folded into article state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.constants import DECISION_STATUS, ERROR_OUT_OF_RANGE


def decision_status(decision: Column) -> Column:
    """Article status that follows from a decision."""
    return (
        F.when(decision == "accept", F.lit(DECISION_STATUS["accept"]))
        .when(decision == "reject", F.lit(DECISION_STATUS["reject"]))
        .otherwise(F.lit(DECISION_STATUS["low_confidence"]))
    )


def _events(fetches: DataFrame, evaluations: DataFrame, overrides: DataFrame | None, skips: DataFrame | None) -> DataFrame:
    """All state-changing log rows in one narrow shape.

    ``rank`` orders events of the same second: a fetch, its range check, the
    evaluation, a manual override.
    """
    none_text, none_time = F.lit(None).cast("string"), F.lit(None).cast("timestamp")

    def shaped(frame, at, rank, *, status=none_text, error=none_text, clears=F.lit(True), failed=F.lit(False),
               published=none_time, accepted=F.lit(False)):
        return frame.select(
            "article_id",
            F.struct(at.alias("at"), F.lit(rank).alias("rank"), F.col("id").alias("id")).alias("seq"),
            status.alias("status"), error.alias("error"), clears.alias("sets_error"), failed.alias("failed"),
            published.alias("published_at"), accepted.alias("accepted"),
        )

    failed = F.col("status") == "failed"
    events = shaped(
        fetches, F.col("fetched_at"), 0, error=F.when(failed, F.col("error")), failed=failed,
        published=F.when(~failed, F.col("published_at")) if "published_at" in fetches.columns else none_time,
    ).unionByName(
        shaped(
            evaluations, F.col("evaluated_at"), 2, status=decision_status(F.col("decision")),
            accepted=F.col("decision") == "accept",
        )
    )
    if skips is not None:
        events = events.unionByName(
            shaped(skips, F.col("skipped_at"), 1, status=F.lit("skipped_out_of_range"), error=F.lit(ERROR_OUT_OF_RANGE))
        )
    if overrides is not None:
        events = events.unionByName(
            shaped(overrides, F.col("changed_at"), 3, status=F.col("status"), clears=F.lit(False))
        )
    return events


def fold_events(
    fetches: DataFrame, evaluations: DataFrame, overrides: DataFrame | None = None, skips: DataFrame | None = None
) -> DataFrame:
    """What the new log rows change, one row per article.

    The logs meet in one union and one aggregation with a partial step, so all
    of them cost a single shuffle, and an article with very many log rows is
    reduced where the rows are read.
    """
    seq = F.col("seq")
    return _events(fetches, evaluations, overrides, skips).groupBy("article_id").agg(
        F.count_if(F.col("failed")).cast("int").alias("failures"),
        F.max_by("status", F.when(F.col("status").isNotNull(), seq)).alias("new_status"),
        F.max_by(F.struct("error"), F.when(F.col("sets_error"), seq)).alias("last_error"),
        F.min_by("published_at", F.when(F.col("published_at").isNotNull(), seq)).alias("found_published_at"),
        F.max(F.when(F.col("accepted"), seq)).alias("last_accept"),
        F.max(seq).alias("last_event"),
        F.max(F.when(F.col("status").isNotNull(), seq)).alias("status_seq"),
        F.max(F.when(F.col("sets_error"), seq)).alias("error_seq"),
        F.min(F.when(F.col("published_at").isNotNull(), seq)).alias("published_seq"),
    )


_SEQ = "struct<at:timestamp,rank:int,id:bigint>"
_MARKS = ("last_event", "status_seq", "error_seq", "last_accept", "published_seq")

# columns that folding may change, with the marks
FOLDED = ("status", "retry_count", "published_at", "collected_at", "updated_at", "error", "marks")


def with_marks(articles: DataFrame) -> DataFrame:
    """A snapshot that remembers which log rows decided its values (column ``marks``).

    Folding batches of the log into such a snapshot gives the same state in whatever
    order the batches come, because a late row is measured against its place in the log.
    """
    return articles.withColumn("marks", F.struct(*[F.lit(None).cast(_SEQ).alias(name) for name in _MARKS]))


def fold_state(
    articles: DataFrame,
    fetches: DataFrame,
    evaluations: DataFrame,
    overrides: DataFrame | None = None,
    skips: DataFrame | None = None,
) -> DataFrame:
    """The new article snapshot after new log rows.

    - a failed fetch adds a retry and sets the error; a success or an
      evaluation clears it;
    - the publication time is filled once, by the first success that knows it;
    - the status follows the latest evaluation, range skip or manual override;
    - the collection time is that of the latest acceptance and stays afterwards.

    Failed evaluations change nothing here; they are only logged.
    """
    change = fold_events(fetches, evaluations, overrides, skips)
    kept = "marks" in articles.columns

    def mark(name: str) -> Column:
        return F.col(f"marks.{name}") if kept else F.lit(None).cast(_SEQ)

    def later(name: str) -> Column:
        """Whether the new log rows decide: they have such a row, and none after it was seen."""
        return F.col(name).isNotNull() & F.coalesce(F.col(name) > mark(name), F.lit(True))

    # a time the article had before any log row stays; of the log's the earliest counts
    earlier = mark("published_seq").isNotNull() & F.coalesce(F.col("published_seq") < mark("published_seq"), F.lit(False))
    new = {
        "status": F.when(later("status_seq"), F.col("new_status")).otherwise(F.col("status")),
        "retry_count": (F.col("retry_count") + F.coalesce("failures", F.lit(0))).cast("int"),
        "published_at": F.when(earlier | F.col("published_at").isNull(), F.coalesce("found_published_at", "published_at")).otherwise(F.col("published_at")),
        "collected_at": F.when(later("last_accept"), F.col("last_accept.at")).otherwise(F.col("collected_at")),
        "updated_at": F.when(later("last_event"), F.col("last_event.at")).otherwise(F.col("updated_at")),
        "error": F.when(later("error_seq"), F.col("last_error.error")).otherwise(F.col("error")),
    }
    if kept:
        # a fill counts as the log's only where the log gave the time
        filled = F.when(F.col("published_at").isNull() | mark("published_seq").isNotNull(), F.least(mark("published_seq"), F.col("published_seq")))
        newest = [F.greatest(mark(name), F.col(name)).alias(name) for name in _MARKS[:-1]]
        new["marks"] = F.struct(*newest, filled.alias("published_seq"))
    joined = articles.join(change, articles.id == change.article_id, "left")
    return joined.select(*[new.get(name, F.col(name)).alias(name) for name in articles.columns])
