"""Near-duplicate detection: banded MinHash, sequential Bayesian verification, exact confirmation.

1. One pass over the texts makes a sketch per document: the size and a 128-bit
   digest of its set of word shingles and a MinHash signature.  Documents of one
   digest have the same set and form a class; from here on only classes count.
2. Classes that agree in a band of the signature share a bucket.  A bucket is not
   turned into all its pairs: every member is compared with one leader, the links
   found are contracted, and what is still apart takes part in the next round with
   another leader.  Leaders are the members that share buckets with most others:
   of copies with many kinds of changes, those nearest to the original.  What stays apart after ``ROUNDS`` rounds is compared pair by
   pair, so no bucket is cut, but only pairs that can link meet: shingles that no
   other set holds and bits that only one of two bitmaps has set tell how many
   shingles two sets can share at most, which bounds their similarity.
3. A pair is compared in batches of hashes.  After each batch it is dropped when
   the posterior probability that its similarity reaches the threshold (uniform
   prior, binomial matches) is below ``MISS``.
4. Survivors are confirmed on their whole sets, with integer arithmetic.

Two sets link when ``100 * |A and B| >= percent * |A or B|``.  The chance that a
pair at the threshold meets in no band is (1 - t^5)^32: 7e-9 for t = 0.85 and
3e-6 for t = 0.8; above the threshold it is smaller.

Words are runs of bytes other than blanks 0x20 and 0x09-0x0D, after lower-casing
A-Z.  A text with fewer words than a shingle is one shingle; a null, empty or
blank text has an empty set and is linked with nothing.  Rows that agree in id and
text are one document and share its fate.  A null id is larger than any other.
Extra columns are carried by ``near_dedup``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import arrays
from gleaner.llm.common import own_name, with_group_facts
from gleaner.operators.membership import MOST_BITS, id_bitmaps, possibly_in
from gleaner.session import written

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
BATCH = 32
MISS = 1e-8
ROUNDS = 2
BITS_PER_TEXT = 64
WORDS = 16  # 64-bit words of the bitmaps that bound the similarity of what is left

_mixers = arrays.mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
_FACTORS, _MASKS = _mixers[:HASHES] | np.uint64(1), _mixers[HASHES:]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a chunk."""
    lowered = np.where((data >= 65) & (data <= 90), data + 32, data)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    # a row ends a word: rows are kept apart by a blank after each
    stops = offsets[1:] + np.arange(len(offsets) - 1)
    wide = np.zeros(len(data) + len(stops), bool)
    place = np.ones(len(wide), bool)
    place[stops] = False
    wide[place] = ~blank
    starts, ends = arrays.runs(wide)
    spelled, _, numbers = arrays.distinct(lowered[~blank], np.concatenate([[0], np.cumsum(ends - starts)]))
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, spelled), np.uint64, len(spelled))[numbers]
    firsts = np.searchsorted(starts, offsets + np.arange(len(offsets)))
    sets = []
    joined = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for i in range(width if len(joined) else 0):
        joined = joined * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - width + 1 + i]
    joined = arrays.mixed(joined)
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if b - a >= width:
            sets.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for word in words[a:b]:
                whole = arrays.mixed(whole + word)
            sets.append(whole)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def digest(shingles: np.ndarray) -> bytes:
    """16 bytes that stand for the whole set."""
    once = arrays.mixed(shingles + np.uint64(len(shingles)))
    return np.array([once.sum(dtype=np.uint64), arrays.mixed(once).sum(dtype=np.uint64)], "<u8").tobytes()


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``HASHES`` 32-bit minima for each set; sets must not be empty."""
    flat = np.concatenate(sets)
    firsts = np.concatenate([[0], np.cumsum([len(part) for part in sets])])[:-1]
    result = np.empty((len(sets), HASHES), np.uint32)
    for i in range(HASHES):
        hashed = (((flat ^ _MASKS[i]) * _FACTORS[i]) >> np.uint64(32)).astype(np.uint32)
        result[:, i] = np.minimum.reduceat(hashed, firsts)
    return result


def _sketch(width: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrays.string_bytes(batch.column("text"))
            sizes, digests, signed = [], [], []
            for start, stop in arrays.chunks(offsets):
                part = offsets[start : stop + 1]
                sets = shingle_sets(data[part[0] : part[-1]], part - part[0], width)
                filled = [one for one in sets if len(one)]
                rows = iter(signatures(filled)) if filled else iter(())
                sizes += [len(one) for one in sets]
                digests += [digest(one) if len(one) else None for one in sets]
                signed += [next(rows).tobytes() if len(one) else None for one in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()),
                 pa.array(digests, pa.binary()), pa.array(signed, pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "set_key", "signature"],
            )

    return sketch


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), HASHES)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        bands = _matrix(batch.column("signature")).astype(np.uint64).reshape(len(batch), BANDS, ROWS)
        keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[:2])
        for row in range(ROWS):
            keys = arrays.mixed(keys + bands[:, :, row])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column("node").to_numpy(), BANDS)), pa.array(keys.ravel().view(np.int64))], names=["node", "bucket"]
        )


def fewest_matches(percent: int, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes seen, matches below which a pair is dropped) after each batch.

    With a uniform prior the posterior of the similarity after m matches of n is
    Beta(m + 1, n - m + 1), and P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    bounds, t = [], percent / 100
    for seen in range(BATCH, HASHES + 1, BATCH):
        below, matches = 0.0, 0
        while matches <= seen:
            below += comb(seen + 1, matches) * t**matches * (1 - t) ** (seen + 1 - matches)
            if below >= miss:
                break
            matches += 1
        bounds.append((seen, matches))
    return bounds


def _prune(percent: int):
    bounds = fewest_matches(percent)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            left, right = _matrix(batch.column("left_signature")), _matrix(batch.column("right_signature"))
            alive, matches, seen = np.arange(len(batch)), np.zeros(len(batch), int), 0
            for stop, fewest in bounds:
                matches = matches + (left[alive, seen:stop] == right[alive, seen:stop]).sum(axis=1)
                alive, matches = alive[matches >= fewest], matches[matches >= fewest]
                seen = stop
            yield batch.select(["left", "right"]).take(pa.array(alive))

    return prune


def _whole_sets(width: int):
    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrays.string_bytes(batch.column("text"))
            wanted, nodes, found, held = batch.column("set_key").to_pylist(), batch.column("node").to_pylist(), [], []
            for start, stop in arrays.chunks(offsets):
                part = offsets[start : stop + 1]
                for row, one in enumerate(shingle_sets(data[part[0] : part[-1]], part - part[0], width), start):
                    if len(one) and digest(one) == wanted[row]:
                        found.append(nodes[row])
                        held.append(one.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(held, pa.binary())], names=["node", "shingles"])

    return whole_sets


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for row, (a, b) in enumerate(zip(batch.column("left_set").to_pylist(), batch.column("right_set").to_pylist())):
                left, right = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                places = np.minimum(np.searchsorted(right, left), len(right) - 1)
                both = int((right[places] == left).sum())
                if 100 * both >= percent * (len(left) + len(right) - both):
                    good.append(row)
            yield batch.select(["left", "right"]).take(pa.array(good, pa.int64()))

    return confirm


class _Matcher:
    """Compares pairs of classes; holds the written tables the comparisons read."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, percent: int):
        self.docs, self.classes, self.width, self.percent = docs, classes, width, percent

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, shingles) of the given classes, from the texts."""
        asked = written(nodes.join(self.classes.select("node", "doc_id", "text_hash", "set_key"), "node"), "asked-classes")
        # few texts are asked for: bitmaps of their hashes keep the others out of the shuffle
        bits = min(max(BITS_PER_TEXT * asked.count(), 1 << 15), MOST_BITS)
        docs = possibly_in(self.docs, "text_hash", id_bitmaps(asked, "text_hash", bits), bits)
        same = F.col("d.doc_id").eqNullSafe(F.col("a.doc_id")) & F.col("d.text_hash").eqNullSafe(F.col("a.text_hash"))
        texts = docs.alias("d").join(asked.alias("a"), same).select("a.node", "a.set_key", "d.text")
        return written(texts.mapInArrow(_whole_sets(self.width), "node long, shingles binary"), "whole-sets").dropDuplicates(["node"])

    def links(self, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """The pairs (left, right) of classes that link; the pairs must be distinct."""
        sketches = self.classes.select("node", "n_shingles", "signature")
        left = sketches.toDF("left", "left_size", "left_signature")
        right = sketches.toDF("right", "right_size", "right_signature")
        likely = (
            pairs.join(right, "right").join(left, "left")
            .filter(F.least("left_size", "right_size") * 100 >= F.greatest("left_size", "right_size") * self.percent)
            .select("left", "right", "left_signature", "right_signature")
            .mapInArrow(_prune(self.percent), "left long, right long")
        )
        likely = written(likely, "likely-pairs")
        if sets is None:
            sets = self.sets(likely.select(F.explode(F.array("left", "right")).alias("node")).distinct())
        return (
            likely.join(sets.toDF("right", "right_set"), "right").join(sets.toDF("left", "left_set"), "left")
            .select("left", "right", "left_set", "right_set")
            .mapInArrow(_confirm(self.percent), "left long, right long")
        )


def contract(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label, met) after joining whatever the links (left, right) connect.

    Every label that has a smaller one beside it hooks to the smallest, hooks are
    shortened by two jumps, and links between the new labels are looked at again.
    """
    while True:
        known = labels.select("node", "label")
        a, b = known.toDF("left", "left_label"), known.toDF("right", "right_label")
        apart = (
            links.join(a, "left").join(b, "right").filter("left_label != right_label")
            .select(F.greatest("left_label", "right_label").alias("label"), F.least("left_label", "right_label").alias("low"))
        )
        hooks = written(apart.groupBy("label").agg(F.min("low").alias("low")), "hooks")
        if hooks.isEmpty():
            return labels
        for _ in range(2):
            hooks = hooks.join(hooks.toDF("low", "lower"), "low", "left").select("label", F.coalesce("lower", "low").alias("low"))
        labels = written(labels.join(hooks, "label", "left").select("node", F.coalesce("low", "label").alias("label"), "met"), "labels")


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id, kept.

    ``component_id`` is the smallest id that links lead to, ``kept`` tells the one
    document of the component that stays (smallest id, then smallest text_hash).
    """
    docs = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text"),
    ).withColumn("text_hash", F.xxhash64("text"))
    sketches = written(
        docs.mapInArrow(_sketch(width), "doc_id long, text_hash long, n_shingles long, set_key binary, signature binary"), "sketches"
    )
    total = sketches.count()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = F.min(order)
    members = (
        sketches.filter("n_shingles > 0").groupBy("set_key")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("members"), F.min(F.struct("n_shingles", "signature")).alias("sketch"))
    )
    classes = written(
        members.select(
            F.monotonically_increasing_id().alias("node"), "set_key", "members", "first.doc_id", "first.text_hash", "sketch.n_shingles", "sketch.signature"
        ),
        "classes",
    )
    held = classes.select("node", "signature").mapInArrow(_band_rows, "node long, bucket long")
    shared = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = written(with_group_facts(held, shared, "bucket", "size", total * BANDS).select("bucket", "node", "size"), "buckets")
    held_rows = buckets.count()
    met = buckets.groupBy("node").agg(F.sum("size").alias("met"))
    labels = written(met.select("node", F.col("node").alias("label"), "met"), "labels")
    matcher = _Matcher(docs, classes, width, percent)
    for number in range(ROUNDS + 1):
        apart = _apart(buckets, labels, held_rows)
        if apart.isEmpty():
            break
        if number < ROUNDS:
            found = matcher.links(_with_leaders(apart, number, held_rows))
        else:
            sets = matcher.sets(apart.select("node").distinct())
            found = matcher.links(_with_all(apart, classes, sets, percent), sets)
        links = written(found, "links")
        if not links.isEmpty():
            labels = contract(labels, links)
    return _decisions(sketches, classes, labels, order, total)


def _apart(buckets: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """(bucket, node, label, met) of the buckets whose members are not one component yet."""
    labelled = buckets.select("bucket", "node").join(labels, "node")
    split = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"))
    return written(
        with_group_facts(labelled, split.filter("low != high"), "bucket", "size", total).select("bucket", "node", "label", "met"), "apart"
    )


def _with_leaders(apart: DataFrame, number: int, total: int) -> DataFrame:
    """Each member beside the leader of its bucket, another one in every round."""
    fitness = F.struct("met", F.xxhash64("node"), "node", "label")
    # after the first round one that stands alone goes first
    first = F.max(F.when(F.col("label") == F.col("node"), fitness)) if number else F.max(fitness)
    leaders = apart.groupBy("bucket").agg(F.coalesce(first, F.max(fitness)).alias("leader"), F.count(F.lit(1)).alias("size"))
    beside = with_group_facts(apart, leaders, "bucket", "size", total).filter("label != leader.label")
    return beside.select(F.col("leader.node").alias("left"), F.col("node").alias("right")).distinct()


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, held in zip(batch.column("node").to_pylist(), batch.column("shingles").to_pylist()):
            shingles = np.frombuffer(held, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(shingles), node)), pa.array(shingles)], names=["node", "shingle"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bit per shingle, placed by its hash."""
    for batch in batches:
        maps = []
        for held in batch.column("shingles").to_pylist():
            bits = np.zeros(64 * WORDS, bool)
            bits[np.frombuffer(held, np.uint64) % np.uint64(64 * WORDS)] = True
            maps.append(np.packbits(bits).view(np.int64))
        flat = np.concatenate(maps) if maps else np.zeros(0, np.int64)
        column = pa.ListArray.from_arrays(pa.array(np.arange(len(maps) + 1) * WORDS, pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column("node"), column], names=["node", "bits"])


def _with_all(apart: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of a bucket that are still apart and can link.

    At least as many shingles of one set are missing in the other as no other set
    holds, and as bits are set in its bitmap alone.  That bounds the common ones, o,
    and the similarity of sets of n and m shingles by o / (n + m - o).  A set of
    which too many shingles stand alone links with none.  Sizes that allow a link
    lie in one or in neighbouring classes of a logarithmic scale.
    """
    alone = (
        sets.mapInArrow(_each_shingle, "node long, shingle long").groupBy("shingle")
        .agg(F.count(F.lit(1)).alias("holders"), F.min("node").alias("node")).filter("holders = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    )
    bitmaps = sets.mapInArrow(_bitmaps, "node long, bits array<long>")
    facts = (
        classes.select("node", "n_shingles").join(bitmaps, "node").join(alone, "node", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
        .filter((F.col("n_shingles") - F.col("alone")) * 100 >= F.col("n_shingles") * percent)
    )
    words = [f"word_{i}" for i in range(WORDS)]
    facts = facts.select("node", "n_shingles", "alone", *[F.col("bits")[i].alias(word) for i, word in enumerate(words)])
    able = written(apart.select("bucket", "node", "label").join(facts, "node"), "able")
    step = float(np.log(100 / percent))
    scale = F.floor(F.log("n_shingles") / F.lit(step))
    left = able.withColumn("scale", scale).alias("a")
    right = able.withColumn("scale", F.explode(F.array(scale, scale + 1, scale - 1))).alias("b")

    # o / (n + m - o) >= t for o = n - missing is (n - missing) * (1 + t) >= (n + m) * t
    least = (F.col("a.n_shingles") + F.col("b.n_shingles")) * percent

    def fits(one: str, missing) -> Column:
        return (F.col(f"{one}.n_shingles") - missing) * (100 + percent) >= least

    def only_in(one: str, other: str) -> Column:
        bits = [F.bit_count(F.col(f"{one}.{word}").bitwiseAND(F.bitwise_not(F.col(f"{other}.{word}")))) for word in words]
        return sum(bits[1:], bits[0])

    can = (
        (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.scale") == F.col("b.scale"))
        & (F.col("a.node") < F.col("b.node")) & (F.col("a.label") != F.col("b.label"))
        & fits("a", F.col("a.alone")) & fits("b", F.col("b.alone")) & fits("a", only_in("a", "b")) & fits("b", only_in("b", "a"))
    )
    return left.join(right, can).select(F.col("a.node").alias("left"), F.col("b.node").alias("right")).distinct()


def _decisions(sketches: DataFrame, classes: DataFrame, labels: DataFrame, order, total: int) -> DataFrame:
    labelled = classes.join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    keepers = labelled.groupBy("label").agg(F.min(order).alias("keeper"))
    facts = labelled.join(keepers, "label").select("set_key", "members", "keeper")
    rows = sketches.select("doc_id", "text_hash", "n_shingles", "set_key")
    met = with_group_facts(rows.filter("n_shingles > 0"), facts, "set_key", "members", total)
    linked = met.select(
        "doc_id", "text_hash", "n_shingles", F.col("keeper.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & F.col("text_hash").eqNullSafe(F.col("keeper.text_hash"))).alias("kept"),
    )
    empty = rows.filter("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.union(empty)


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that stay, one of each component, with all their columns."""
    dropped = near_duplicates(docs, width, percent, id_column, text_column).filter(~F.col("kept")).select(
        F.col("doc_id").alias("dropped_id"), F.col("text_hash").alias("dropped_hash")
    ).distinct()
    mark = own_name(docs, "text_hash")
    rows = docs.withColumn(mark, F.xxhash64(F.col(f"`{text_column}`"))).alias("d")
    gone = rows.join(
        dropped.alias("x"),
        F.col(f"d.`{id_column}`").cast("long").eqNullSafe(F.col("x.dropped_id")) & F.col(f"d.{mark}").eqNullSafe(F.col("x.dropped_hash")),
        "left_anti",
    )
    return gone.drop(mark)
