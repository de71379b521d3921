"""A trie of conversation prefixes by digests of fixed-length blocks of turns.

Every turn becomes a digest of its role and text.  ``BLOCK`` successive turns make a
block, and a conversation's blocks are chained: a block is identified by the digest
of the chain before it and its own turns.  Conversations are grouped by these blocks
first.  Where a chain goes on in one block only, its turns are nodes as they are;
only where several blocks follow one chain are the distinct blocks (not their
conversations) taken apart, turn by turn, and grouped by where they still agree.
So what conversations share is grouped once a block, and turn boundaries only
matter where siblings diverge.

Sums over subtrees need no walk.  The smallest member of a node is the smallest
member of the rest of its own path below, so every conversation c is smallest from
some depth on; ``shared`` is the number of words before it.  The tokens saved below
a node that begins after w words are the sum of shared - w over all its members but
the smallest.  Leaves are counted by their smallest members likewise.

Turns are ordered by number (null first), then role, then digest of the text; null
roles and texts are empty, repeated rows are turns of their own.  Rows without a
conversation id belong to none and are left out; an empty table has no nodes.
Other columns are ignored.

A conversation may hold any share of the rows: its turns are numbered by ranges and
its blocks hashed in parallel; only the chain, a digest a block, passes one task in
order.  Node keys of many rows (the root) meet their facts by a broadcast of few
large groups.  The digest of the members that end at a node is taken over pieces of
65,536 ids at most, in one stream a node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import with_group_facts
from gleaner.session import written

BLOCK = 4
ROOT = hashlib.sha256(b"").digest()
_WORD = r"[^\x20\x09-\x0D]+"
_PIECE_BITS = 16


def _digest(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def _numbers_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each row among those of its conversation in this partition, which is sorted."""
    last, before = None, 0
    for batch in batches:
        if not len(batch):
            continue
        ids = batch.column("conv_id").to_numpy()
        at = np.arange(len(ids))
        first = np.concatenate([[ids[0] != last], ids[1:] != ids[:-1]])
        start = np.maximum.accumulate(np.where(first, at, 0))
        place = at - start
        place[: int(np.argmax(first)) if first.any() else len(ids)] += before
        last, before = ids[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, "place"])


def turns(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """conv_id, position (from 0), digest of role and text, and words of the text of every turn."""
    said = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    told = F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(""))
    narrow = written(
        conversations.filter(F.col(f"`{conv_id}`").isNotNull()).select(
            F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), told.alias("role"),
            _digest(F.concat(F.octet_length(told).cast("string"), F.lit(":"), told, said)).alias("digest"),
            F.regexp_count(said, F.lit(_WORD)).cast("long").alias("words"),
        ),
        "turns",
    )
    order = ["conv_id", "turn", "role", "digest"]
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "words", F.spark_partition_id().alias("part"))
    placed = written(ranged.mapInArrow(_numbers_within, "conv_id long, digest binary, words long, part int, place long"), "placed-turns")
    # only the first conversation of a range can have begun in the ranges before it
    cut = placed.groupBy("part").agg(F.min("conv_id").alias("conv_id"))
    sizes = placed.join(F.broadcast(cut.select("conv_id").distinct()), "conv_id", "left_semi").groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")
    moved = sizes.select("conv_id", "part", earlier.alias("earlier")).filter("earlier > 0")
    return placed.join(F.broadcast(moved), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("earlier", F.lit(0))).alias("position"), "digest", "words"
    )


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains the blocks of each conversation, which come in order."""
    last, chain, before = None, ROOT, 0
    for batch in batches:
        parents, chains, words_before = [], [], []
        for one, digests, words in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "digests", "block_words"))):
            if one != last:
                last, chain, before = one, ROOT, 0
            parents.append(chain)
            words_before.append(before)
            chain = hashlib.sha256(chain + digests).digest()
            chains.append(chain)
            before += words
        added = [pa.array(parents, pa.binary()), pa.array(chains, pa.binary()), pa.array(words_before, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "parent", "chain", "before"])


def _blocks(rows: DataFrame) -> DataFrame:
    """A row for each block of each conversation: its digests and words, and the chains before and after it."""
    packed = rows.groupBy("conv_id", F.expr(f"position div {BLOCK}").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("position", "digest", "words"))).alias("turns")
    ).select(
        "conv_id", "block",
        F.aggregate("turns", F.expr("cast('' AS binary)"), lambda all_, t: F.concat(all_, t["digest"])).alias("digests"),
        F.transform("turns", lambda t: t["words"]).alias("words"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda sum_, t: sum_ + t["words"]).alias("block_words"),
    )
    kind = "conv_id long, block long, digests binary, words array<long>, block_words long, parent binary, chain binary, before long"
    return packed.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_chain, kind)


_SUMS = ("n_convs", "n_ends", "shared", "leaves")


def _turn_nodes(siblings: DataFrame) -> DataFrame:
    """Nodes of the turns in blocks: as they are in an only block, grouped where blocks of one chain diverge."""
    ids = F.expr(
        "transform(sequence(0, size(words)), j -> IF(j = 0, parent, unhex(sha2(concat(parent, substring(digests, 1, 32 * j)), 256))))"
    )
    each = siblings.withColumn("ids", ids).select("*", F.posexplode("words").alias("j", "w")).select(
        F.expr("ids[j + 1]").alias("id"), F.expr("ids[j]").alias("parent_id"), (F.col("block") * BLOCK + F.col("j") + 1).alias("depth"),
        (F.col("before") + F.coalesce(F.expr("aggregate(slice(words, 1, j), 0L, (a, x) -> a + x)"), F.lit(0))).alias("before"),
        "n_convs", F.when(F.expr("j = size(words) - 1"), F.col("n_ends")).otherwise(0).alias("n_ends"), "shared", "leaves", "first", "diverges",
    )
    grouped = each.filter("diverges").groupBy("id", "parent_id", "depth", "before").agg(
        *(F.sum(name).alias(name) for name in _SUMS), F.min("first").alias("first")
    )
    return each.filter("NOT diverges").drop("diverges").unionByName(grouped)


def _root(members: DataFrame) -> DataFrame:
    """The node all conversations begin with, if there is any."""
    return members.agg(
        F.count("*").alias("n_convs"), F.coalesce(F.sum(F.when(F.col("n_turns") == 0, 1).otherwise(0)), F.lit(0)).cast("long").alias("n_ends"),
        F.sum("shared").alias("shared"), F.sum("leaves").alias("leaves"), F.min(F.struct("conv_id", "shared")).alias("first"),
    ).filter("n_convs > 0").select(
        F.lit(bytearray(ROOT)).alias("id"), F.lit(None).cast("binary").alias("parent_id"), F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("before"), "*",
    )


def _ends_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined pieces of each node, which come in order."""
    last, state = None, hashlib.sha256()
    for batch in batches:
        done = []
        for one, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            if one != last:
                if last is not None:
                    done.append((last, state.hexdigest()))
                last, state = one, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in done], pa.binary()), pa.array([b for _, b in done])], names=["id", "ends_sha256"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], names=["id", "ends_sha256"])


def _ends(at: DataFrame) -> DataFrame:
    pieces = at.groupBy("id", F.shiftright("conv_id", _PIECE_BITS).alias("piece")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("text")
    )
    return pieces.repartition("id").sortWithinPartitions("id", "piece").mapInArrow(_ends_digest, "id binary, ends_sha256 string")


def trie(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes over turns as ``turns`` gives them.

    ``conversations`` has a row for each conv_id, also of those without any turn.
    Returns conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256 for each node.
    """
    blocks = written(_blocks(rows), "trie-blocks")
    lengths = blocks.groupBy("conv_id").agg(
        F.max("block").alias("last"), F.sum(F.size("words")).alias("n_turns"), F.sum("block_words").alias("n_words")
    )
    lengths = conversations.join(lengths, "conv_id", "left").select(
        "conv_id", "last", F.coalesce("n_turns", F.lit(0)).alias("n_turns"), F.coalesce("n_words", F.lit(0)).alias("n_words")
    )
    lengths = written(lengths, "trie-conversations")
    total = blocks.count()

    def grouped(members: DataFrame, name: str) -> DataFrame:
        """Block by block: members, ends, and whether other blocks follow the same chain."""
        sized = members.withColumn("size", F.coalesce(F.col("last") + 1, F.lit(0))).select("conv_id", "last", "shared", "leaves", "size")
        told = with_group_facts(blocks, sized, "conv_id", "size", total)
        # all that is grouped by but the chain follows from the chain
        groups = told.groupBy("parent", "chain", "block", "before", "digests", "words").agg(
            F.count("*").alias("n_convs"), F.sum(F.when(F.col("block") == F.col("last"), 1).otherwise(0)).cast("long").alias("n_ends"),
            F.sum("shared").alias("shared"), F.sum("leaves").alias("leaves"), F.min(F.struct("conv_id", "shared")).alias("first"),
        )
        groups = written(groups, name)
        after = groups.groupBy("parent").agg(F.count("*").alias("following"))
        joined = with_group_facts(groups, after, "parent", "following", total)
        return _turn_nodes(joined.withColumn("diverges", F.col("following") > 1)).unionByName(_root(members))

    unknown = lengths.select("*", F.lit(0).cast("long").alias("shared"), F.lit(0).cast("long").alias("leaves"))
    own = grouped(unknown, "trie-groups").groupBy(F.col("first.conv_id").alias("conv_id")).agg(
        F.min(F.struct("depth", "before")).alias("top"), F.max((F.col("n_convs") == F.col("n_ends")).cast("long")).alias("leaves")
    )
    members = lengths.join(own, "conv_id", "left").select(
        "conv_id", "last", "n_turns", F.coalesce("top.before", "n_words").alias("shared"), F.coalesce("leaves", F.lit(0)).cast("long").alias("leaves")
    )
    nodes = written(grouped(written(members, "trie-members"), "trie-sums"), "trie-nodes")
    children = nodes.filter(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("id").alias("parent_id"), F.col("first.conv_id").alias("parent_conv_id")).join(children, "parent_id")
    above = written(above, "trie-parents")
    at = blocks.join(lengths.select("conv_id", F.col("last").alias("block")), ["conv_id", "block"]).select("conv_id", F.col("chain").alias("id")).unionByName(
        lengths.filter("n_turns = 0").select("conv_id", F.lit(bytearray(ROOT)).alias("id"))
    )
    below = above.select(F.col("parent_id").alias("id"), "n_children").join(_ends(at), "id", "full")
    full = nodes.join(below, "id", "left")
    placed = with_group_facts(full.filter("depth > 0"), above.withColumnRenamed("n_children", "siblings"), "parent_id", "siblings", nodes.count())
    everything = placed.drop("siblings").unionByName(full.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    saved = F.col("shared") - F.col("first.shared") - (F.col("n_convs") - 1) * F.col("before")
    return everything.select(
        F.col("first.conv_id").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """The nodes of all prefixes of the conversations as they are."""
    rows = written(turns(conversations, **columns), "trie-turns")
    return trie(rows, rows.select("conv_id").distinct())
