"""Registration of queries together with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.catalog.oracle_tables import compose
from gleaner.functions.times import iso_z
from gleaner.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def portable(frame: DataFrame) -> DataFrame:
    """Types every engine writes alike: times as ISO text, lists joined by ``|``."""

    def plain(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            column = iso_z(column)
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column, "|")
        elif isinstance(field.dataType, (T.MapType, T.StructType)):
            column = F.to_json(column)
        return column.alias(field.name)

    return frame.select(*[plain(field) for field in frame.schema.fields])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name; ``sql`` is its twin, if any."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = lambda spark, sf: portable(function(prepare(spark), sf))
        if sql is not None:
            ORACLES[function.__name__] = compose(sql)
        return function

    return register
