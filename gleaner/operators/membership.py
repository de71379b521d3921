"""Which rows can have an id of a given set, told by bitmaps before any shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ids above this number share bits with others, so that at most 128 MiB are broadcast
# however large ids are; a join then decides.
MOST_BITS = 1 << 30


def id_bitmaps(ids: DataFrame, column: str, most_bits: int = MOST_BITS) -> DataFrame:
    """(bucket, bitmap) of the ids; rows without one are passed over."""
    place = F.pmod(F.col(column), F.lit(most_bits))
    return ids.filter(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap")
    )


def possibly_in(rows: DataFrame, column: str, bitmaps: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows whose id is in the set, and with ids of ``most_bits`` and more a few others."""
    place = F.pmod(F.col(f"r.{column}"), F.lit(most_bits))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("b.bitmap"), (F.floor(bit / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    met = rows.alias("r").join(F.broadcast(bitmaps).alias("b"), F.bitmap_bucket_number(place) == F.col("b.bucket"))
    return met.filter(F.getbit(byte, (bit % 8).cast("int")) == 1).select("r.*")
