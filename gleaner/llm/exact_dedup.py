"""Exact dedup with a two-pass Bloom filter, in DataFrame functions only.

Pass one hashes every text, sets two bits per hash in a blocked bitmap and keeps
only the bits that were set twice or more.  Pass two probes that bitmap: a row
whose bits are not both among them is unique and passes straight through, without
a shuffle.  The others (every repeated text, and few unique ones) are shuffled on
their SHA-256, which decides.

Two texts are equal when identical after lower-casing A-Z; a null text counts as
empty.  The row with the largest id stays; a null id is smaller than any.  Among
rows that agree in text and id exactly one stays.  An empty table gives an empty
result.  Columns beside the two named are carried along by ``exact_dedup``,
whatever their names.

The bitmap has ``bits_per_row`` bits for each row but at most ``most_bits``, which
bounds what is broadcast (``most_bits / 8`` bytes).  With more rows than that is
made for, more unique rows take the shuffle; results do not change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import ascii_lower, own_name, with_group_facts
from gleaner.session import written

BITS_PER_ROW = 24
MOST_BITS = 1 << 30
_BLOCK = 8 * 4096  # bits of the bitmaps that bitmap_construct_agg builds
_HALF = _BLOCK // 2


def text_sha256(text: Column) -> Column:
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def _places(digest: Column, blocks: int) -> tuple[Column, Column, Column]:
    """The block of a hash and its two bits, one in either half of the block."""
    first = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    second = F.conv(F.substring(digest, 16, 15), 16, 10).cast("long")
    return (
        F.pmod(first, F.lit(blocks)).cast("int"),
        second.bitwiseAND(_HALF - 1).cast("int"),
        (F.shiftright(second, 20).bitwiseAND(_HALF - 1) + _HALF).cast("int"),
    )


def blocks_for(rows: int, bits_per_row: int = BITS_PER_ROW, most_bits: int = MOST_BITS) -> int:
    return max(1, min(rows * bits_per_row, most_bits) // _BLOCK)


def repeated_bits(prints: DataFrame, digest: str, blocks: int) -> DataFrame:
    """(block, bitmap) of the bits that two or more rows set."""
    block, low, high = _places(F.col(digest), blocks)
    bits = prints.select(block.alias("block"), F.explode(F.array(low, high)).alias("bit"))
    repeated = bits.groupBy("block", "bit").count().filter("count > 1")
    return repeated.groupBy("block").agg(F.bitmap_construct_agg(F.col("bit")).alias("bitmap"))


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (bit / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return F.getbit(byte, bit % 8) == 1


def flagged(rows: DataFrame, digest: str, bits: DataFrame, blocks: int, flag: str) -> DataFrame:
    """Rows with a flag that is true for every repeated hash and for few others."""
    block, low, high = _places(F.col(f"r.`{digest}`"), blocks)
    joined = rows.alias("r").join(F.broadcast(bits).alias("b"), block == F.col("b.block"), "left")
    bitmap = F.col("b.bitmap")
    maybe = bitmap.isNotNull() & _is_set(bitmap, low) & _is_set(bitmap, high)
    return joined.select("r.*", F.coalesce(maybe, F.lit(False)).alias(flag))


def duplicate_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    bits_per_row: int = BITS_PER_ROW, most_bits: int = MOST_BITS,
) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    prints = written(
        docs.select(
            F.col(id_column).alias("doc_id"), text_sha256(F.col(text_column)).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "prints",
    )
    total = prints.count()
    blocks = blocks_for(total, bits_per_row, most_bits)
    rows = flagged(prints, "text_sha256", repeated_bits(prints, "text_sha256", blocks), blocks, "maybe")
    alone = rows.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    maybe = rows.filter("maybe")
    groups = maybe.groupBy("text_sha256").agg(
        F.max(F.struct("doc_id", "row")).alias("keeper"), F.count(F.lit(1)).alias("group_size")
    )
    met = with_group_facts(maybe, groups, "text_sha256", "group_size", total)
    return alone.union(met.select(
        "doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keeper.row")).alias("kept"), "text_sha256",
    ))


def exact_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    bits_per_row: int = BITS_PER_ROW, most_bits: int = MOST_BITS,
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    digest, flag = own_name(docs, "digest"), own_name(docs, "maybe")
    prints = written(docs.select(text_sha256(F.col(text_column)).alias("digest")), "prints")
    blocks = blocks_for(prints.count(), bits_per_row, most_bits)
    bits = repeated_bits(prints, "digest", blocks)
    rows = flagged(docs.withColumn(digest, text_sha256(F.col(f"`{text_column}`"))), digest, bits, blocks, flag)
    columns = [F.col(f"`{name}`") for name in docs.columns]
    whole = F.struct(*columns)
    hashable = [F.col(f"`{name}`") for name, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    order = F.struct(F.col(f"`{id_column}`"), F.xxhash64(*hashable))
    one_each = rows.filter(F.col(flag)).groupBy(digest).agg(F.max_by(whole, order).alias("kept"))
    return rows.filter(~F.col(flag)).select(*columns).union(one_each.select("kept.*"))
