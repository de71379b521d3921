"""Substring search by an index of trigrams.

The index has two tables.  ``texts`` holds id and searched columns in hash buckets of
the id; ``grams`` holds, for every three neighbouring characters (ASCII letters folded)
and bucket, the ids whose columns have them, in folders by a hash of the gram.  A
search reads the lists of the needle's rarest grams, intersects them, opens only the
buckets that candidates lie in and verifies the pattern there, so results are those
of the full scan.  A needle without three characters in a row (``%`` and ``_`` are
wildcards) is searched by the full scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import UPPER
from gleaner.operators.filters import matching
from gleaner.streaming.buckets import bucket_of, buckets_for

SEARCHED = ("title", "url", "source_name")
_PARTS = 256  # folders of grams
_RAREST = 4  # lists that are intersected


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(_PARTS)).cast("int")


def _grams(value: Column) -> Column:
    """The distinct trigrams of a text; none for null and short ones."""
    folded = F.translate(value, UPPER, UPPER.lower())
    places = F.when(F.length(folded) >= 3, F.sequence(F.lit(1), F.length(folded) - 2))
    return F.coalesce(F.array_distinct(F.transform(places, lambda i: F.substr(folded, i, F.lit(3)))), F.array().cast("array<string>"))


def needle_grams(needle: str) -> list[str]:
    """The trigrams that every match has: those of its parts between wildcards."""
    folded = needle.strip().translate(str.maketrans(UPPER, UPPER.lower()))
    parts = re.split("[%_]", folded)
    return sorted({part[i : i + 3] for part in parts for i in range(len(part) - 2)})


def build_index(articles: DataFrame, folder: str, names: Sequence[str] = SEARCHED, buckets: int | None = None) -> None:
    """Write the index of articles with unique ids."""
    buckets = buckets or buckets_for(articles.count())
    placed = articles.select("id", *names, bucket_of(F.col("id"), buckets).alias("bucket"))
    placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/texts")
    each = placed.select("id", "bucket", F.explode(F.array_distinct(F.flatten(F.array(*[_grams(F.col(name)) for name in names])))).alias("gram"))
    lists = each.groupBy("gram", "bucket").agg(F.collect_list("id").alias("ids")).withColumn("part", _part(F.col("gram")))
    lists.repartition("part", "bucket").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/grams")


def candidates(spark: SparkSession, folder: str, needle: str) -> DataFrame | None:
    """(id, bucket) of all articles that may match; None if the index can't tell."""
    wanted = needle_grams(needle)
    if not wanted:
        return None
    listed = spark.createDataFrame([(gram,) for gram in wanted], "gram string")
    parts = [row.part for row in listed.select(_part(F.col("gram")).alias("part")).distinct().collect()]
    lists = spark.read.schema("gram string, bucket int, ids array<long>, part int").parquet(f"{folder}/grams").filter(
        F.col("part").isin(parts) & F.col("gram").isin(wanted)
    )
    sizes = {row.gram: row.n for row in lists.groupBy("gram").agg(F.sum(F.size("ids")).alias("n")).collect()}
    rarest = sorted(wanted, key=lambda gram: sizes.get(gram, 0))[:_RAREST]
    return (
        lists.filter(F.col("gram").isin(rarest)).select("bucket", F.explode("ids").alias("id"))
        .groupBy("bucket", "id").agg(F.count("*").alias("grams")).filter(F.col("grams") == len(rarest)).select("id", "bucket")
    )


def search(spark: SparkSession, folder: str, needle: str, names: Sequence[str] = SEARCHED) -> DataFrame:
    """id and searched columns of the articles that match."""
    texts = spark.read.parquet(f"{folder}/texts")
    found = candidates(spark, folder, needle) if needle.strip() else None
    if found is not None:
        opened = [row.bucket for row in found.select("bucket").distinct().collect()]
        texts = texts.filter(F.col("bucket").isin(opened)).join(found.select("id"), "id", "left_semi")
    return matching(texts, needle, *names).select("id", *names)
