"""A keyed table in hash buckets, of which a micro-batch rewrites only what it touches.

Rows lie in folders ``rows/batch=n/bucket=b``.  The manifest of a version says, for
each bucket, which batch wrote its base and which batches wrote changes since; the
newest row of a key holds.  A batch reads the buckets its keys fall into and writes
its changed rows; a bucket whose changes have grown to a quarter of its base, or to
eight layers, is written anew in the same step.  So the work of a batch follows the
batch, not the table, and the files of untouched buckets stay as they are.

Version ``n + 1`` is made from version ``n`` alone, and its manifest appears in one
step after its rows: a batch that is replayed after a failure overwrites what it left
and gives the same version.  The two newest versions are kept.  A manifest has one
entry per bucket, and buckets number 65,536 at most, however large the table is.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.session import drop_folder, point_to, pointed_to

LEAST_BUCKETS, MOST_BUCKETS = 8, 1 << 16
BUCKET_ROWS = 100_000
MOST_LAYERS = 8
_SHARE = 4  # changes of a quarter of the base


def buckets_for(rows: int) -> int:
    """Buckets of some hundred thousand rows, within bounds."""
    return min(max(rows // BUCKET_ROWS, LEAST_BUCKETS), MOST_BUCKETS)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Buckets:
    """One version of a bucketed table."""

    spark: SparkSession
    folder: str
    version: int
    key: str
    count: int
    schema: T.StructType
    parts: dict[int, list[list[int]]]  # bucket: [batch, rows] of the base, then of later changes
    facts: dict[str, int]  # small numbers that go with the version

    @classmethod
    def create(cls, rows: DataFrame, folder: str, key: str, count: int, **facts: int) -> Buckets:
        """Write a table (unique in ``key``, which is never null) as version 0."""
        new = cls(rows.sparkSession, folder, 0, key, count, rows.schema, {}, facts)
        new._write(rows)
        return new._published({bucket: [[0, n]] for bucket, n in new._sizes().items()}, facts)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, version: int) -> Buckets:
        told = json.loads(pointed_to(spark, f"{folder}/manifest-{version}"))
        parts = {int(bucket): layers for bucket, layers in told["parts"].items()}
        return cls(spark, folder, version, told["key"], told["count"], T.StructType.fromJson(told["schema"]), parts, told["facts"])

    @classmethod
    def latest(cls, spark: SparkSession, folder: str) -> Buckets:
        """The newest version that was written to its end."""
        found = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest-*")
        names = [one.getPath().getName() for one in found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found)]
        return cls.load(spark, folder, max(int(name.rpartition("-")[2]) for name in names if name.rpartition("-")[2].isdigit()))

    def rows(self, only: set[int] | None = None) -> DataFrame:
        """The newest row of every key, of the given buckets or of all."""
        chosen = {bucket: layers for bucket, layers in self.parts.items() if only is None or bucket in only}
        single = self._scan({bucket: layers for bucket, layers in chosen.items() if len(layers) == 1})
        layered = self._scan({bucket: layers for bucket, layers in chosen.items() if len(layers) > 1})
        newest = layered.groupBy(self.key).agg(F.max_by(F.struct(*self.schema.names), "batch").alias("row")).select("row.*")
        return single.select(*self.schema.names).unionByName(newest)

    def touched(self, keys: DataFrame) -> dict[int, int]:
        """Buckets that distinct keys fall into, and how many fall into each."""
        counts = keys.select(bucket_of(F.col(self.key), self.count).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
        return {row.bucket: row.n for row in counts.collect()}

    def having(self, keys: DataFrame, touched: dict[int, int]) -> DataFrame:
        """The rows of the given distinct keys."""
        return self.rows(set(touched)).join(keys.select(self.key), self.key, "left_semi")

    def before(self, keys: DataFrame, touched: dict[int, int]) -> DataFrame:
        """The rows a batch with these distinct keys starts from: theirs, and all rows of buckets that will be written anew."""
        due = self._due(touched)
        whole, others = self.rows(due), {bucket: n for bucket, n in touched.items() if bucket not in due}
        return whole.unionByName(self.having(keys, others)) if others else whole

    def advanced(self, after: DataFrame, touched: dict[int, int], **facts: int) -> Buckets:
        """The next version: what became of the rows of ``before``, and new rows."""
        due = self._due(touched)
        new = replace(self, version=self.version + 1)
        new._write(after.select(*self.schema.names))
        sizes, parts = new._sizes(), {}
        for bucket in {*self.parts, *sizes}:
            layers = [] if bucket in due else self.parts.get(bucket, [])
            parts[bucket] = layers + ([[new.version, sizes[bucket]]] if bucket in sizes else [])
        return new._published({bucket: layers for bucket, layers in parts.items() if layers}, self.facts | facts)

    def forget_before(self) -> None:
        """Drop rows and manifests that neither this version nor the one before it uses."""
        gone = self.version - 2
        if gone < 0:
            return
        before = self.load(self.spark, self.folder, self.version - 1)
        used = {batch for one in (self, before) for layers in one.parts.values() for batch, _ in layers}
        if pointed_to(self.spark, f"{self.folder}/manifest-{gone}"):
            older = self.load(self.spark, self.folder, gone)
            for batch in {batch for layers in older.parts.values() for batch, _ in layers} - used:
                drop_folder(self.spark, f"{self.folder}/rows/batch={batch}")
            drop_folder(self.spark, f"{self.folder}/manifest-{gone}")

    def _due(self, touched: dict[int, int]) -> set[int]:
        """Touched buckets whose changes would outgrow their share, so that they are written anew."""
        due = set()
        for bucket, more in touched.items():
            layers = self.parts.get(bucket, [])
            if layers and (len(layers) >= MOST_LAYERS or _SHARE * (more + sum(n for _, n in layers[1:])) >= layers[0][1]):
                due.add(bucket)
        return due

    def _write(self, rows: DataFrame) -> None:
        placed = rows.withColumn("bucket", bucket_of(F.col(self.key), self.count))
        placed.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.folder}/rows/batch={self.version}")

    def _sizes(self) -> dict[int, int]:
        path = f"{self.folder}/rows/batch={self.version}"
        kind = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        return {row.bucket: row.n for row in self.spark.read.schema(kind).parquet(path).groupBy("bucket").agg(F.count("*").alias("n")).collect()}

    def _scan(self, parts: dict[int, list[list[int]]]) -> DataFrame:
        kind = T.StructType([*self.schema.fields, T.StructField("batch", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
        paths = [f"{self.folder}/rows/batch={batch}/bucket={bucket}" for bucket, layers in parts.items() for batch, _ in layers]
        if not paths:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).option("basePath", f"{self.folder}/rows").parquet(*paths)

    def _published(self, parts: dict[int, list[list[int]]], facts: dict[str, int]) -> Buckets:
        told = {"key": self.key, "count": self.count, "schema": self.schema.jsonValue(), "parts": parts, "facts": facts}
        point_to(self.spark, f"{self.folder}/manifest-{self.version}", json.dumps(told))
        return replace(self, parts=parts, facts=facts)
