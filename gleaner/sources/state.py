"""Per-source state between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_source_state(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Replace status, error and check time of the sources just polled.

    A validator (etag, modification time) that did not come back is kept from
    the previous run.
    """
    old, new = previous.alias("o"), current.alias("n")
    polled = F.col("n.source_name").isNotNull()

    def latest(name: str):
        return F.when(polled, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}")).alias(name)

    return old.join(new, F.col("o.source_name") == F.col("n.source_name"), "full_outer").select(
        F.coalesce("n.source_name", "o.source_name").alias("source_name"),
        F.coalesce("n.etag", "o.etag").alias("etag"),
        F.coalesce("n.modified", "o.modified").alias("modified"),
        latest("last_status"),
        latest("last_error"),
        latest("checked_at"),
    )
