"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import prepare

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

# Rows of text handed to a Python worker at once; a batch is held in memory.
ROWS_PER_BATCH = "512"


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings of the corpus operators: the library's, and small Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    return prepare(spark)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def own_name(frame: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of the frame has that name in any case."""
    taken = {name.lower() for name in frame.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def with_group_facts(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, least: int = 1_000) -> DataFrame:
    """Inner join of rows with the facts of their group, whatever the sizes of groups.

    Groups of over ``total / 10,000`` rows (``least`` at least) number 10,000 at most,
    so their facts are broadcast and their rows stay where they are.  The rows of
    the others meet them in a shuffle in which no key has more rows than that.
    ``groups`` has a row per key and counts the rows of each in ``size``.
    """
    most = max(least, total // 10_000)
    rows, names = rows.alias("r"), [name for name in groups.columns if name != key]
    large = groups.filter(F.col(size) > most).alias("g")
    tagged = rows.join(F.broadcast(large), F.col(f"r.{key}") == F.col(f"g.{key}"), "left")
    facts = [F.col(f"g.{name}") for name in names]
    at_once = tagged.filter(F.col(f"g.{size}").isNotNull()).select("r.*", *facts)
    rest = tagged.filter(F.col(f"g.{size}").isNull()).select("r.*").alias("r")
    small = groups.filter(F.col(size) <= most).alias("g")
    return at_once.union(rest.join(small, F.col(f"r.{key}") == F.col(f"g.{key}")).select("r.*", *facts))
