"""Histogram sort into shards of near equal bytes, in DataFrame functions only.

Rows are ordered by (hash of the text, id, row number), so that equal texts lie
beside each other.  Splitters are found without sorting: every round counts the
exact bytes and rows of the bins between candidate boundaries over all partitions,
keeps the bins in which a wanted boundary falls, and cuts those finer, until the
boundary is met within ``tolerance`` bytes or between two neighbouring rows.  Rows
are then placed by comparison with the splitters and exchanged once.

Law ``bytes``: with the default tolerance of 0 the shard of a row is
``floor(bytes before it * shards / all bytes)``, so shards differ from an equal
part by less than one row.  A group of equal texts is cut only where a boundary
falls inside it; a group with a third of all rows spreads over a third of the
shards.

Shards are made of cells (``cells_per_shard`` each, more for large inputs), whose
boundaries are found in the same rounds.  A cell is what one task numbers, so a
task's share does not depend on the number of shards or on hot texts.

Size: bytes of the text in UTF-8 (null: none) plus 8.  The checksum of a null text
is that of no bytes, 0.  Null ids come first; repeated rows are kept, in the order
of the row number they got when the narrow table was written.  An empty table
gives an empty result.  Extra columns are not carried.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import written

TOP_BITS, BINS = 12, 4096
KEY_BITS = 60
CELLS_PER_SHARD = 6
CELL_BYTES = 256 << 20
_KEYS = ("key", "id", "row")
_LEAST = -(1 << 63)


@dataclass(frozen=True)
class Bin:
    """Rows whose keys before ``level`` equal ``fixed`` and whose key there is in [low, high]."""

    fixed: tuple[int, ...]
    low: int
    high: int
    before: int  # bytes of all rows that come earlier
    size: int
    rows: int


def keyed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The narrow table that is sorted: doc_id, size, text_crc32, key, id, row, top."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    key = F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")
    return docs.select(
        F.col(f"`{id_column}`").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), key.alias("key"),
        F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(_LEAST)).alias("id"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("top", F.shiftrightunsigned("key", KEY_BITS - TOP_BITS).cast("int"))


def _finer(rows: DataFrame, cells: list[Bin]) -> dict[Bin, list[Bin]]:
    """Exact bytes and rows of the finer bins of each cell, counted in one job."""
    table = []
    for number, cell in enumerate(cells):
        level = len(cell.fixed)
        key = cell.fixed[0] if level else cell.low
        width = (cell.high - cell.low) // BINS + 1
        second = cell.fixed[1] if level > 1 else None
        table.append((number, key >> (KEY_BITS - TOP_BITS), level, key, second, cell.low, cell.high, width))
    spark = rows.sparkSession
    cut = spark.createDataFrame(
        table, "cell int, top int, level int, first long, second long, low long, high long, width long"
    ).alias("c")
    here = F.when(F.col("level") == 0, F.col("key")).when(F.col("level") == 1, F.col("id")).otherwise(F.col("row"))
    inside = (
        (F.col("r.top") == F.col("c.top"))
        & ((F.col("level") == 0) | (F.col("key") == F.col("first")))
        & ((F.col("level") < 2) | (F.col("id") == F.col("second")))
        & here.between(F.col("low"), F.col("high"))
    )
    # distances may pass 2^63, hence decimals
    distance = here.cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)")
    number = F.floor(distance / F.col("width").cast("decimal(20,0)"))
    counted = (
        rows.alias("r").join(F.broadcast(cut), inside)
        .select("cell", number.cast("int").alias("bin"), here.alias("here"), "size")
        .groupBy("cell", "bin")
        .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"), F.min("here").alias("low"), F.max("here").alias("high"))
        .orderBy("cell", "bin").collect()
    )
    result: dict[Bin, list[Bin]] = {}
    for found in counted:
        cell = cells[found.cell]
        parts = result.setdefault(cell, [])
        before = parts[-1].before + parts[-1].size if parts else cell.before
        parts.append(Bin(cell.fixed, found.low, found.high, before, found.size, found.rows))
    return result


def find_splitters(rows: DataFrame, targets: list[int], top: list[Bin], tolerance: int) -> list[tuple[int, int, int]]:
    """For each target the first key that has at least so many bytes before it, within ``tolerance``.

    ``targets`` ascend; no more than their number of bins is refined in a round,
    and a round returns at most ``BINS`` counts for each of them.
    """
    least = (_LEAST, _LEAST, _LEAST)
    open_targets, done = {target: None for target in targets}, {}
    bins_of = {None: top}
    while open_targets:
        wanted: dict[Bin, list[int]] = {}
        for target, cell in open_targets.items():
            bins = bins_of[cell]
            place = bisect_right(bins, target - 1, key=lambda part: part.before) - 1
            part = bins[max(place, 0)]
            if target <= part.before + tolerance:
                done[target] = _start(part)
            elif part.before + part.size <= target + tolerance or part.rows == 1:
                # the next row is the boundary: one step past the last key of the bin
                done[target] = _after(part)
            else:
                wanted.setdefault(_narrowed(part), []).append(target)
        open_targets = {target: cell for cell, those in wanted.items() for target in those}
        if wanted:
            bins_of = _finer(rows, list(wanted))
    return [done.get(target, least) for target in targets]


def _narrowed(part: Bin) -> Bin:
    """A bin of one key value is cut on the next key."""
    if part.low == part.high and len(part.fixed) < 2:
        return Bin((*part.fixed, part.low), _LEAST, -_LEAST - 1, part.before, part.size, part.rows)
    return part


def _start(part: Bin) -> tuple[int, int, int]:
    return tuple([*part.fixed, part.low, _LEAST, _LEAST][:3])


def _after(part: Bin) -> tuple[int, int, int]:
    return tuple([*part.fixed, part.high + 1, _LEAST, _LEAST][:3])


def place_rows(rows: DataFrame, splitters: list[tuple[int, int, int]]) -> DataFrame:
    """Rows with ``cell``: how many splitters are not above their key."""
    by_top: dict[int, list[tuple[int, int, int]]] = {}
    for splitter in splitters:
        by_top.setdefault(max(splitter[0], 0) >> (KEY_BITS - TOP_BITS), []).append(splitter)
    table, base = [], 0
    for top in range(1 << TOP_BITS):
        own = by_top.get(top, [])
        table.append((top, base, own))
        base += len(own)
    bounds = rows.sparkSession.createDataFrame(
        table, "top int, base int, bounds array<struct<key:long,id:long,row:long>>"
    ).alias("b")
    own = F.struct("r.key", "r.id", "r.row")
    passed = F.size(F.filter("b.bounds", lambda bound: bound <= own))
    return rows.alias("r").join(F.broadcast(bounds), F.col("r.top") == F.col("b.top")).select(
        "r.*", (F.col("b.base") + F.when(F.size("b.bounds") > 0, passed).otherwise(0)).alias("cell")
    )


def shard_by_bytes(
    docs: DataFrame, shards: int, tolerance: int = 0, id_column: str = "doc_id", text_column: str = "text",
    cells_per_shard: int = CELLS_PER_SHARD, cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """doc_id, size, text_crc32, shard (from 0) and slot (gapless from 0 within the shard)."""
    if shards < 1:
        raise ValueError("at least one shard")
    rows = written(keyed(docs, id_column, text_column), "keyed")
    counts = (
        rows.groupBy("top").agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"), F.min("key").alias("low"), F.max("key").alias("high")
        ).orderBy("top").collect()
    )
    top, total = [], 0
    for part in counts:
        top.append(Bin((), part.low, part.high, total, part.size, part.rows))
        total += part.size
    cells = max(cells_per_shard, -(-total // (shards * cell_bytes)))
    # smallest whole number t with t * n >= k * total: rows starting at t or later are in part k
    targets = sorted({-(-k * total // (shards * cells)) for k in range(1, shards * cells)}) if top else []
    splitters = find_splitters(rows, targets, top, tolerance) if top else []
    # a repeated splitter makes an empty cell; cell k begins with splitter k
    first = {target: place for place, target in enumerate(targets)}
    shard_starts = [first[-(-k * total // shards)] + 1 for k in range(1, shards)] if top else []
    placed = place_rows(rows, splitters)
    shard_of = rows.sparkSession.createDataFrame(
        [(cell, bisect_right(shard_starts, cell)) for cell in range(len(splitters) + 1)], "cell int, shard int"
    )
    held = placed.groupBy("cell").count().join(F.broadcast(shard_of), "cell")
    # one row per cell: the number of cells is fixed by the two parameters and the bytes per cell
    earlier = F.sum("count").over(Window.partitionBy("shard").orderBy("cell")) - F.col("count")
    bases = held.select("cell", "shard", earlier.alias("base"))
    numbered = placed.withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy(*_KEYS)))
    return numbered.join(F.broadcast(bases), "cell").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("place") - 1).cast("long").alias("slot")
    )

