"""Logs as intervals, to ask for the state of any past moment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET_BITS = 16  # a window sees at most this many bits of ids of one key


def intervals(log: DataFrame, key: str, at: str, *fields: str, order: str = "id") -> DataFrame:
    """When each log row was the latest of its key.

    As everywhere, "latest" is by id among the rows known so far, and a row is known
    from its time ``at`` on: it holds until the first time of any row with a larger id.
    Rows that never held (a larger id came with an earlier time) are left out, and so are
    rows without a time.  A key's rows are looked at in pieces of neighbouring ids, whose
    earliest times meet in a second step, so no key gathers in one task.
    """
    bucket = F.shiftright(F.col(order), _BUCKET_BITS)
    rows = log.filter(F.col(at).isNotNull()).select(key, order, F.col(at).alias("valid_from"), *fields, bucket.alias("_bucket"))
    within = Window.partitionBy(key, "_bucket").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(key).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy(key, "_bucket").agg(F.min("valid_from").alias("_first"))
    later = pieces.select(key, "_bucket", F.min("_first").over(behind).alias("_later"))
    ended = rows.withColumn("_soon", F.min("valid_from").over(within)).join(later, [key, "_bucket"])
    valid_to = F.least("_soon", "_later")  # passes over nulls
    return ended.withColumn("valid_to", valid_to).filter(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from"))).select(
        key, order, *fields, "valid_from", "valid_to"
    )


def as_of(spans: DataFrame, moment: Column) -> DataFrame:
    """The row of every key that held at a moment: a filter, without looking at the log again."""
    return spans.filter((F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (F.col("valid_to") > moment)))


def at_moments(spans: DataFrame, moments: Sequence[Column], name: str = "moment") -> DataFrame:
    """The rows that held at each of a few moments; a row comes once for every moment it held at."""
    held = F.filter(
        F.array(*moments), lambda m: (F.col("valid_from") <= m) & (F.col("valid_to").isNull() | (F.col("valid_to") > m))
    )
    return spans.withColumn(name, F.explode(held))


def joined_as_of(rows: DataFrame, spans: DataFrame, key: str, moment: str, width: str = "month") -> DataFrame:
    """Inner join of rows with what held for their key at their own moment.

    Both sides meet by key and calendar period, so a key's rows meet only the spans
    of their period; a span takes part in every period it touches up to the last
    moment asked for.
    """
    start = lambda at: F.date_trunc(width, at)
    last = rows.agg(F.max(moment)).scalar()
    step = F.expr(f"INTERVAL 1 {width.upper()}")
    reaching = spans.filter(F.col("valid_from") <= last).withColumn(
        "_period", F.explode(F.sequence(start(F.col("valid_from")), start(F.least(F.coalesce("valid_to", last), last)), step))
    )
    asked = rows.withColumn("_period", start(F.col(moment)))
    met = asked.join(reaching, [key, "_period"])
    return met.filter((F.col("valid_from") <= F.col(moment)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col(moment)))).drop("_period")
