"""Byte-level BPE by a global shuffle of distinct words, and decoding by a join.

Encoding.  Texts are split into words by the pattern of the rank file.  The words of
a block (neighbouring documents of some megabytes) are numbered by first occurrence,
so a document becomes the numbers of its words by position.  The distinct words of
every block are dealt to buckets by a hash and shuffled; a bucket is handled whole,
so each distinct word of the corpus is encoded once, however often and in however
many blocks it occurs: a word of every text has one row a block.  Ids go back to
the blocks, and documents are put together from their numbers, position by position.

The input is read twice, for its words and for its numbers, so that neither texts
nor words with their positions are kept on disk.  Both readings must see the same
rows in the same order, as scans of files do; every block carries a checksum of its
texts, and a difference is an error, never a wrong result.

Decoding.  The distinct ids of a block are joined with the table of token bytes (as
many rows as the vocabulary, so it is broadcast) and put back by position.

Null and empty texts have no ids.  Null ids decode to null, no ids to no bytes; an
unknown id is an error.  The bytes of ids cut out of a text need not be UTF-8, so
they stay binary.  Text and ids columns are replaced by what they become; all other
columns are carried, and repeated rows stay repeated.  A document is held by one task.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm import arrays
from gleaner.llm.common import own_name

BLOCK_BYTES = 1 << 24  # text of a block in encoding
BLOCK_IDS = 1 << 20  # ids of a block in decoding
BUCKET_BYTES = 1 << 25  # text for each bucket of words
LEAST_BUCKETS = 64
_SHORT = 200  # bytes of a word that are searched plainly
_NONE = 1 << 60


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    """The ids of all tokens by their bytes."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge(word: bytes, ranked: dict[bytes, int]) -> list[int]:
    """Ids of one word: the neighbours of least rank are joined, the leftmost first, until none has a rank."""
    if word in ranked:
        return [ranked[word]]
    if len(word) > _SHORT:
        return _merge_long(word, ranked)
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranked.get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
    while pairs:
        least = min(pairs)
        if least == _NONE:
            break
        at = pairs.index(least)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at < len(pairs):
            pairs[at] = ranked.get(parts[at] + parts[at + 1], _NONE)
        if at:
            pairs[at - 1] = ranked.get(parts[at - 1] + parts[at], _NONE)
    return [ranked[part] for part in parts]


def _merge_long(word: bytes, ranked: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs, for words of any length."""
    count = len(word)
    stops, before, after = list(range(1, count + 1)), list(range(-1, count - 1)), list(range(1, count + 1))
    alive = [True] * count
    heap: list[tuple[int, int, int]] = []

    def offer(left: int) -> None:
        right = after[left]
        if right < count:
            rank = ranked.get(word[left : stops[right]])
            if rank is not None:
                heap.append((rank, left, stops[right])) if not ready else heapq.heappush(heap, (rank, left, stops[right]))

    ready = False
    for left in range(count - 1):
        offer(left)
    heapq.heapify(heap)
    ready = True
    while heap:
        _, left, stop = heapq.heappop(heap)
        right = after[left] if alive[left] else count
        if right == count or stops[right] != stop:
            continue
        alive[right] = False
        stops[left], after[left] = stop, after[right]
        if after[left] < count:
            before[after[left]] = left
        offer(left)
        if before[left] >= 0:
            offer(before[left])
    return [ranked[word[i : stops[i]]] for i in range(count) if alive[i]]


_LATIN = 0x240  # code points below it have a first byte below 0xC9 in UTF-8


@functools.cache
def _latin(pattern: str):
    """The pattern for texts of code points below ``_LATIN`` alone, with its classes of letters written out, which
    the standard library matches faster; None if it has escapes other than classes by property and blanks."""
    import regex

    def members(escape: str) -> str:
        return "".join(re.escape(chr(point)) for point in range(_LATIN) if regex.match(escape, chr(point)))

    out, inside = [], False
    for part in re.split(r"(\\p\{\w+\}|\\.|\[\^?|\])", pattern):
        if part.startswith("["):
            inside = True
        elif part == "]":
            inside = False
        elif part.startswith("\\p{") or part == r"\s":
            part = members(part) if inside else f"[{members(part)}]"
        elif part == r"\S" and not inside:
            part = f"[^{members(chr(92) + 's')}]"
        elif part.startswith("\\"):
            return None
        out.append(part)
    return re.compile("".join(out))


class _Numbers(dict):
    """Numbers words by first occurrence."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _split(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[tuple[int, bool, list]]:
    """Block by block: its id, whether it ends here, and a batch's rows, numbers of words and the state so far."""
    import regex

    any_text, latin = regex.compile(pattern), _latin(pattern)
    base, block = 0, 0
    numbers, seal, held = _Numbers(), 0, 0
    for batch in batches:
        if len(batch):
            base = batch.column("part")[0].as_py() << 32
        data, offsets = arrays.string_bytes(batch.column(0))
        raw = data.tobytes()
        for start, stop in arrays.chunks(offsets):
            bounds = offsets[start : stop + 1].tolist()
            plain = latin is not None and data[bounds[0] : bounds[-1]].max(initial=0) < 0xC9
            words_of = (latin if plain else any_text).findall
            found = []
            for a, b in zip(bounds, bounds[1:]):
                found.append(np.fromiter(map(numbers.__getitem__, words_of(raw[a:b].decode())), np.int64))
                seal = zlib.crc32(raw[a:b], zlib.crc32(b"\x00", seal))
            held += bounds[-1] - bounds[0]
            full = held >= BLOCK_BYTES
            yield base + block, full, [batch.slice(start, stop - start), found, numbers, seal]
            if full:
                block, numbers, seal, held = block + 1, _Numbers(), 0, 0
    if held or numbers or seal:
        yield base + block, True, [None, [], numbers, seal]


_WORDS = "block long, seal long, bucket int, words binary, sizes binary, numbers binary"


def _words_of(pattern: str, buckets: int):
    """The distinct words of each block, dealt to buckets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ends, (_, _, numbers, seal) in _split(batches, pattern):
            if not ends:
                continue
            words = [word.encode() for word in numbers]
            bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            used, firsts = np.unique(bucket[order], return_index=True)
            rows = []
            for one, chosen in zip(used.tolist(), np.split(order, firsts[1:])):
                mine = [words[i] for i in chosen.tolist()]
                sizes = np.fromiter(map(len, mine), np.int64, len(mine))
                gaps = np.diff(chosen, prepend=0)
                rows.append((one, b"".join(mine), arrays.varints(sizes)[0].tobytes(), arrays.varints(gaps)[0].tobytes()))
            columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(rows), pa.int64()), pa.array([seal] * len(rows), pa.int64()), *columns],
                    names=["block", "seal", "bucket", "words", "sizes", "numbers"],
                )

    return work


_CODES = "block long, seal long, numbers binary, ids binary, counts binary"


def _codes_of(path: str):
    """Ids of the words of each row; a bucket's rows come together, and each of its words is encoded once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked, known, bucket = ranks(path), {}, None
        for batch in batches:
            ids_out, counts_out = [], []
            for one, words, sizes in zip(*(batch.column(name).to_pylist() for name in ("bucket", "words", "sizes"))):
                if one != bucket:
                    known, bucket = {}, one
                edges = np.cumsum(arrays.from_varints(sizes)).tolist()
                found = []
                for a, b in zip([0, *edges], edges):
                    word = words[a:b]
                    ids = known.get(word)
                    if ids is None:
                        known[word] = ids = merge(word, ranked)
                    found.append(ids)
                counts = np.fromiter(map(len, found), np.int64, len(found))
                ids_out.append(arrays.varints(np.fromiter(itertools.chain.from_iterable(found), np.int64, int(counts.sum())))[0].tobytes())
                counts_out.append(arrays.varints(counts)[0].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("seal"), batch.column("numbers"), pa.array(ids_out, pa.binary()), pa.array(counts_out, pa.binary())],
                names=["block", "seal", "numbers", "ids", "counts"],
            )

    return work


def _numbered(pattern: str, names: list[str]):
    """Every document as the numbers of its words, and one row with the checksum of each block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for block, ends, (rows, found, _, seal) in _split(batches, pattern):
            if rows is not None:
                kind = rows.column(1).type
                flat, sizes = arrays.varints(np.concatenate(found))
                edges = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, found)])]
                packed = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(flat)])
                nothing = pa.nulls(len(found), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.int64()), nothing, packed, rows.column(1)], names=names)
            if ends:
                one = [pa.array([block], pa.int64()), pa.array([seal], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, kind)]
                yield pa.RecordBatch.from_arrays(one, names=names)

    return work


def _assembled(fields: list[str], ids_column: str):
    """Documents of a block from its codes, which come first, and their numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seals, gathered = None, set(), []
        table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = [0, *(1 + np.flatnonzero(np.diff(blocks))).tolist(), len(batch)]
            for start, stop in zip(cuts, cuts[1:]):
                if start == stop:
                    continue
                part = batch.slice(start, stop - start)
                if blocks[start] != block:
                    block, seals, gathered, table = blocks[start], set(), [], None
                seals |= {seal for seal in part.column("seal").to_pylist() if seal is not None}
                if len(seals) > 1:
                    raise ValueError("the documents changed between two readings; write them to a table first")
                for numbers, ids, counts in zip(*(part.column(name).to_pylist() for name in ("numbers", "ids", "counts"))):
                    if ids is not None:
                        gathered.append((np.cumsum(arrays.from_varints(numbers)), arrays.from_varints(counts), arrays.from_varints(ids)))
                texts = part.filter(part.column("words").is_valid())
                if not len(texts):
                    continue
                if table is None:
                    table = _table(gathered)
                    gathered = []
                begins, counts, ids = table
                packed = texts.column("words")
                flat = arrays.from_varints(b"".join(packed.to_pylist()))
                data = np.frombuffer(b"".join(packed.to_pylist()), np.uint8)
                sizes = [0 if one is None else len(one) for one in packed.to_pylist()]
                edges = np.concatenate([[0], np.cumsum(data < 128)])[np.cumsum([0, *sizes])]
                each = counts[flat]
                whole = ids[arrays.ranges(begins[flat], each)]
                places = np.concatenate([[0], np.cumsum(each)])[edges]
                rows = texts.column("row")
                yield pa.RecordBatch.from_arrays(
                    [*(rows.field(name) for name in fields), pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(whole, pa.int32()))],
                    names=[*fields, ids_column],
                )

    return work


def _table(gathered: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and count of each number's ids, and all ids."""
    if not gathered:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    numbers, counts, ids = (np.concatenate(parts) for parts in zip(*gathered))
    if len(numbers) != numbers.max() + 1 or len(np.unique(numbers)) != len(numbers):
        raise ValueError("words of a block are missing")
    begins, sizes = np.empty(len(numbers), np.int64), np.empty(len(numbers), np.int64)
    begins[numbers], sizes[numbers] = np.cumsum(counts) - counts, counts
    return begins, sizes, ids


def _rows(frame: DataFrame, replaced: str, new: str) -> tuple[DataFrame, list[T.StructField]]:
    """The frame as (replaced column, struct of the others), and the fields of the others."""
    fields = [field for field in frame.schema.fields if field.name.lower() not in (replaced.lower(), new.lower())]
    carried = [F.col(f"`{field.name}`") for field in fields] or [F.lit(None).cast("int").alias(own_name(frame, "none"))]
    return frame.select(F.col(f"`{replaced}`").alias("value"), F.struct(*carried).alias("row")), fields


def encode(
    docs: DataFrame, text_column: str = "text", ids_column: str = "ids", path: str | None = None, pattern: str | None = None,
) -> DataFrame:
    """``docs`` with an array of ids in place of the text, each word encoded as the ranks have it."""
    path, pattern = path or default_path(), pattern or default_pattern()
    texts, fields = _rows(docs, text_column, ids_column)
    texts = texts.withColumn("part", F.spark_partition_id())
    size = texts.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    words = texts.mapInArrow(_words_of(pattern, buckets), _WORDS)
    codes = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_codes_of(path), _CODES)
    names = ["block", "seal", "words", "row"]
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("seal", T.LongType()), T.StructField("words", T.BinaryType()),
        T.StructField("row", texts.schema["row"].dataType),
    ])
    numbered = texts.mapInArrow(_numbered(pattern, names), schema)
    together = codes.unionByName(numbered, allowMissingColumns=True).repartition("block")
    # codes, then checksums, then documents
    order = F.when(F.col("ids").isNotNull(), 0).when(F.col("seal").isNotNull(), 1).otherwise(2)
    out = T.StructType([*fields, T.StructField(ids_column, T.ArrayType(T.IntegerType()))])
    return together.sortWithinPartitions("block", order).mapInArrow(_assembled([f.name for f in fields], ids_column), out)


def token_bytes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The table of token bytes: id, bytes."""
    return spark.createDataFrame([(rank, bytearray(token)) for token, rank in ranks(path or default_path()).items()], "id int, bytes binary")


def _id_blocks(names: list[str]):
    """A block's distinct ids, a row each, and then its documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> Iterator[pa.RecordBatch]:
            parts = [one.column(0) for one in held]
            used = np.unique(np.concatenate([part.flatten().to_numpy(zero_copy_only=False) for part in parts]))
            nothing = [pa.nulls(len(used), column.type) for column in held[0].columns]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *nothing], names=names)
            for one in held:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(one), pa.int32()), *one.columns], names=names)

        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(0).flatten())
            if size >= BLOCK_IDS:
                yield from block()
                held, size = [], 0
        if held:
            yield from block()

    return work


def _spelled(fields: list[str], text_column: str):
    """Documents from their ids, by the bytes of the ids that come before them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = sizes = data = np.zeros(0, np.int64)
        fresh: list[tuple[int, bytes | None]] = []
        for batch in batches:
            listed = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            cuts = [0, *(1 + np.flatnonzero(np.diff(listed.astype(np.int8)))).tolist(), len(batch)]
            for start, stop in zip(cuts, cuts[1:]):
                if start == stop:
                    continue
                part = batch.slice(start, stop - start)
                if listed[start]:
                    fresh += zip(part.column("id").to_pylist(), part.column("bytes").to_pylist())
                    continue
                if fresh:
                    unknown = [one for one, token in fresh if token is None]
                    if unknown:
                        raise ValueError(f"no token has the id {unknown[0]}")
                    numbers = np.array([one for one, _ in fresh])
                    lengths = np.array([len(token) for _, token in fresh])
                    begins, sizes = np.full(numbers.max() + 1, -1), np.zeros(numbers.max() + 1, np.int64)
                    begins[numbers], sizes[numbers] = np.cumsum(lengths) - lengths, lengths
                    data, fresh = np.frombuffer(b"".join(token for _, token in fresh), np.uint8), []
                column = part.column("value")
                ids = column.flatten().to_numpy(zero_copy_only=False)
                if len(ids) and (ids.max() >= len(begins) or begins[ids].min() < 0):
                    raise ValueError("ids came apart from their bytes")
                edges = np.cumsum([0, *(n or 0 for n in pa.compute.list_value_length(column).to_pylist())])
                flat = data[arrays.ranges(begins[ids], sizes[ids])].astype(np.uint8)
                places = np.concatenate([[0], np.cumsum(sizes[ids])])[edges]
                raw, valid = flat.tobytes(), column.is_valid().to_pylist()
                texts = [raw[a:b] if ok else None for a, b, ok in zip(places.tolist(), places[1:].tolist(), valid)]
                rows = part.column("row")
                yield pa.RecordBatch.from_arrays([*(rows.field(name) for name in fields), pa.array(texts, pa.binary())], names=[*fields, text_column])

    return work


def decode(frame: DataFrame, ids_column: str = "ids", text_column: str = "decoded", path: str | None = None) -> DataFrame:
    """``frame`` with the bytes that the ids spell in place of the ids."""
    listed, fields = _rows(frame.withColumn(ids_column, F.col(f"`{ids_column}`").cast("array<int>")), ids_column, text_column)
    names = ["id", "value", "row"]
    schema = T.StructType([T.StructField("id", T.IntegerType()), *(T.StructField(f.name, f.dataType) for f in listed.schema.fields)])
    blocks = listed.mapInArrow(_id_blocks(names), schema)
    # the broadcast table leaves the order of the other side as it is
    joined = blocks.join(F.broadcast(token_bytes(frame.sparkSession, path)), "id", "left").select("id", "bytes", "value", "row")
    out = T.StructType([*fields, T.StructField(text_column, T.BinaryType())])
    return joined.mapInArrow(_spelled([f.name for f in fields], text_column), out)
