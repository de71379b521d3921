"""Benchmark decontamination by size-partitioned MinHash containment, in DataFrame functions only.

Short test items are searched inside long documents.  A text is a set of distinct
shingles of ``width`` words (runs of letters and digits, lower-cased); a text with
fewer words is one shingle, one without words has an empty set and matches nothing.

Every shingle of every document is looked up.  An item that needs fewer than
``FEW`` common shingles is searched exactly: of its n shingles, a document that
holds the needed k holds one of any n - k + 1, so the first n - k + 1 are probed.

For longer items documents are partitioned by the size of their sets, a class per
power of two.  A set of class c is sketched by one-permutation MinHash with
``8 * 2^c`` bins: the least hash of every bin.  An item is sketched anew for every
class it can be contained in, and its first ``PROBES`` bins are looked up among those
of the documents.  The number of bins follows the size, so a shingle that both sets
hold is the least of its bin in the larger one with a chance of about 94 percent,
however long the document is: with ``FEW`` or more common shingles, and 80 percent, an
item is missed with a chance below 1e-9.  Each candidate is verified on the whole
sets: it is a hit when ``100 * common >= percent * size of the item``.

The items are broadcast when their sets have at most ``most_probes`` shingles, and
then only hits are shuffled; beyond that all shingles meet in shuffles, where common
ones are counted without any sketch.

An item that is repeated counts once; of several texts under one item id the best
hit is returned.  Rows that agree in document id and text are one document.  Null
ids are kept as null.  ``clean`` carries all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import own_name

WIDTH, PERCENT = 5, 80
PROBES = 16
FEW = 8  # common shingles from which on the sketch is sure enough
MOST_PROBES = 1_000_000
_SPARE = 3  # bins per possible shingle, as a power of two
_CLASSES = 24


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Sorted distinct hashes of the word shingles."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")

    def of(words: Column) -> Column:
        def at(start: Column) -> Column:
            return F.xxhash64(*[F.get(words, start + i) for i in range(width)])

        whole = F.array(F.xxhash64(F.concat_ws(" ", words)))
        return F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(0), F.size(words) - width), at)).when(F.size(words) > 0, whole)

    # a one-element array, so that the words are made once
    hashes = F.flatten(F.transform(F.array(words), of))
    return F.sort_array(F.array_distinct(F.coalesce(hashes, F.array().cast("array<long>"))))


def _least_of_bin(value: Column, before: Column, size_class: Column) -> Column:
    """Whether a hash is the least of its bin; hashes ascend, a bin is a range of them, and the first has null before it."""
    shift = F.lit(64 - _SPARE) - size_class
    bin_of = lambda one: F.call_function("shiftright", one, shift)
    return before.isNull() | (bin_of(value) != bin_of(before))


def _sketch(hashes: Column, size_class: Column) -> Column:
    """The least hash of every bin."""
    return F.filter(hashes, lambda value, i: _least_of_bin(value, F.get(hashes, i - 1), size_class))


def _bit(size_class: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), size_class)


def _size_class(size: Column) -> Column:
    return F.least(F.ceil(F.log2(size)).cast("int"), F.lit(_CLASSES))


def hits(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT, most_probes: int = MOST_PROBES,
    id_column: str = "doc_id", text_column: str = "text", item_id_column: str = "item_id", item_text_column: str = "text",
) -> DataFrame:
    """doc_id, text_hash, item_id, n_item, n_common for every item that a document contains."""
    wanted = (
        items.select(F.col(f"`{item_id_column}`").alias("item_id"), shingles(F.col(f"`{item_text_column}`"), width).alias("item_set"))
        .filter(F.size("item_set") > 0).distinct().withColumn("n_item", F.size("item_set").cast("long"))
        .withColumn("item", F.xxhash64("item_id", "item_set"))
    )
    needed = F.greatest(F.ceil(F.col("n_item") * percent / 100).cast("int"), F.lit(1))
    sketches = (
        wanted.filter(needed >= FEW)
        .select("item", "item_set", F.explode(F.sequence(_size_class(needed), F.lit(_CLASSES))).alias("class"))
        .select("item", "class", F.explode(F.slice(_sketch(F.col("item_set"), F.col("class")), 1, PROBES)).alias("value"))
        .groupBy("item", "value").agg(F.bit_or(_bit(F.col("class"))).alias("classes"))
    )
    few = wanted.filter(needed < FEW).select(
        "item", F.explode(F.slice("item_set", F.lit(1), F.size("item_set") - needed + 1)).alias("value"), F.lit(None).cast("int").alias("classes")
    )
    sets = docs.select(
        F.col(f"`{id_column}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_column}`")).alias("text_hash"),
        shingles(F.col(f"`{text_column}`"), width).alias("doc_set"),
    ).filter(F.size("doc_set") > 0)
    size_class = _size_class(F.size("doc_set"))
    least = _least_of_bin(F.col("value"), F.get("doc_set", F.col("place") - 1), size_class)
    common = F.size(F.array_intersect("doc_set", "item_set")).cast("long")
    size = wanted.agg(F.sum("n_item")).first()[0] or 0
    if size <= most_probes:
        met = (
            sets.select("*", F.posexplode("doc_set").alias("place", "value")).join(F.broadcast(few.unionByName(sketches)), "value")
            .filter(F.col("classes").isNull() | ((F.col("classes").bitwiseAND(_bit(size_class)) != 0) & least))
            .join(F.broadcast(wanted), "item").withColumn("n_common", common)
        )
    else:
        met = _by_shuffle(sets, wanted)
    return (
        met.filter(F.col("n_common") * 100 >= F.col("n_item") * percent)
        .groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct(F.col("n_common") / F.col("n_item"), "n_item", "n_common")).alias("best"))
        .select("doc_id", "text_hash", "item_id", "best.n_item", "best.n_common")
    )


def _by_shuffle(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Common shingles of documents and items where the items are too many to broadcast."""
    key = ["doc_id", "text_hash"]
    held = sets.select(*key, F.explode("doc_set").alias("value")).distinct()
    asked = wanted.select("item", F.explode("item_set").alias("value"))
    common = held.join(asked, "value").groupBy(*key, "item").agg(F.count(F.lit(1)).alias("n_common"))
    return common.join(wanted.select("item", "item_id", "n_item"), "item")


def clean(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """The documents that contain no item."""
    found = hits(docs, items, width, percent, id_column=id_column, text_column=text_column)
    found = found.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct()
    mark = own_name(docs, "text_hash")
    rows = docs.withColumn(mark, F.xxhash64(F.col(f"`{text_column}`"))).alias("d")
    same = F.col(f"d.`{id_column}`").eqNullSafe(F.col("x.hit_id")) & F.col(f"d.{mark}").eqNullSafe(F.col("x.hit_hash"))
    return rows.join(found.alias("x"), same, "left_anti").drop(mark)
