"""Token ids in files: canonical length-limited Huffman codes from global counts.

Texts are encoded once, with the ``tokenizers`` library, into a table of ids of two
bytes (four for vocabularies above 65,536).  Every id of it is counted; the counts
(one per id of the vocabulary) give code lengths of at most ``LIMIT`` bits by
package-merge, and canonical codes.  Then the ids, not the texts, are put in ascending
order of (document id, hash of the text) by one range exchange and written in blocks.

Files of byte-level BPE with the usual splitting into words are read word by word, and
a word's ids are remembered; every other kind of file gets whole texts.

The format is two Parquet tables in a folder.  ``codebook`` has (id, length).
``blocks`` has a row per independent block of whole documents, at least
``BLOCK_IDS`` ids long but for the last of a part: part and block (their order is
the order of documents), ids of the part before it, ids of documents, their
lengths, the code bits (high bits first, whole 64-bit words) and the bit offset of
every ``STRIDE``-th id.  Decoding walks from all checkpoints of a block at once
through a table of ``2^LIMIT`` entries.

A null or empty text is the end id alone.  Null ids come first; repeated rows are
kept.  An empty table gives files without rows.  Extra columns are not carried.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm import arrays
from gleaner.session import shared_folder

LIMIT = 18
BLOCK_IDS = 1 << 18
STRIDE = 512
MOST_WORDS = 1_200_000  # words a worker remembers
_APOSTROPHE, _BLANK = 39, 32
_SPACE, _LETTER, _DIGIT, _OTHER, _UNSURE = range(5)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _classes() -> np.ndarray:
    """White space, letter, number or other, by the oldest character table at hand.

    Characters it doesn't know may have another class in other tables; texts with
    such characters are left to the library alone.
    """
    table = np.full(0x110001, _UNSURE, np.uint8)
    old = unicodedata.ucd_3_2_0.category
    for point in range(0x110000):
        kind = old(chr(point))
        if kind != "Cn":
            table[point] = {"L": _LETTER, "N": _DIGIT}.get(kind[0], _OTHER)
    spaces = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[spaces] = _SPACE
    return table


def word_starts(points: np.ndarray, kinds: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Where the words of byte-level BPE begin, for texts that lie one after another."""
    count = len(points)
    first = np.zeros(count + 1, bool)
    first[places] = True
    edge = first[:-1].copy()
    edge[1:] |= kinds[1:] != kinds[:-1]
    begins = edge.copy()
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], count)
    space = kinds[starts] == _SPACE
    # the last blank of a run before something stands alone, or joins it if it is a plain blank
    before = np.flatnonzero(space & ~first[ends])
    begins[ends[before] - 1] = True
    joins = before[points[ends[before] - 1] == _BLANK]
    begins[ends[joins]] = False
    # an apostrophe with a short ending: 's 't 'm 'd 're 've 'll
    alone = np.flatnonzero((points[starts] == _APOSTROPHE) & (ends - starts == 1) & begins[starts] & ~first[ends])
    alone = alone[kinds[ends[alone]] == _LETTER] if len(alone) else alone
    if len(alone):
        letter = ends[alone]
        stop = ends[alone + 1]
        one = points[letter]
        two = np.where(letter + 1 < stop, points[np.minimum(letter + 1, count - 1)], 0)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        size = np.where(size == 0, np.where(pair, 2, 0), size)
        letter, stop, size = letter[size > 0], stop[size > 0], size[size > 0]
        begins[letter] = False
        within = letter + size < stop
        begins[(letter + size)[within]] = True
    return np.flatnonzero(begins)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in set(plain)]
    return {byte: chr(byte) for byte in plain} | {byte: chr(256 + i) for i, byte in enumerate(others)}


def _splits_as_usual(told: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE that splits words by its own pattern and changes nothing before."""
    model, before = told["model"], told["pre_tokenizer"] or {}
    odd = any(model.get(name) for name in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    return (
        model["type"] == "BPE" and not odd and told["normalizer"] is None
        and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    )


class Tokens:
    """Encodes batches of texts with the library and remembers the words it has met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = _splits_as_usual(json.loads(self.tokenizer.to_str()))
        self.kinds, self.letters = _classes(), _byte_letters()
        self.words = arrays.Remembered(MOST_WORDS)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        if not self.by_words:
            raw, edges = data.tobytes(), offsets.tolist()
            found = self.tokenizer.encode_batch([raw[a:b].decode() for a, b in zip(edges, edges[1:])], add_special_tokens=False)
            return [np.array(one.ids, np.int32) for one in found]
        points, places = arrays.code_points(data, offsets)
        kinds = self.kinds[points]
        result: list[np.ndarray | None] = [None] * (len(offsets) - 1)
        unsure = np.concatenate([[0], np.cumsum(kinds == _UNSURE)])[places]
        raw = data.tobytes()
        special = any(token.encode() in raw for token in self.added)
        for row in range(len(result)):
            if unsure[row + 1] > unsure[row] or special:
                text = raw[offsets[row] : offsets[row + 1]].decode()
                if unsure[row + 1] > unsure[row] or any(token in text for token in self.added):
                    result[row] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
        starts = word_starts(points, kinds, places) if len(points) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(points)) if len(starts) else starts

        def work_out(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            lengths = (ends - starts)[chosen]
            flat = points[arrays.ranges(starts[chosen], lengths)]
            # all words at once in the letters that stand for their bytes
            mapped = flat.tobytes().decode("utf-32-le").encode().decode("latin-1").translate(self.letters)
            sizes = 1 + (flat >= 0x80).astype(np.int64) + (flat >= 0x800) + (flat >= 0x10000)
            edges = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
            tokenize = self.tokenizer.model.tokenize
            found = [[token.id for token in tokenize(mapped[a:b])] for a, b in zip(edges, edges[1:])]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), counts

        ids, counts = self.words.look_up(points, np.append(starts, len(points)), work_out)
        edges = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, places)]
        return [ids[edges[row] : edges[row + 1]] if one is None else one for row, one in enumerate(result)]


_tokens: dict[str, Tokens] = {}


def _encoded(column: pa.Array, path: str, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of a column of texts with the end id, and the edges of texts in them; some rows at a time."""
    tokens = _tokens.get(path) or _tokens.setdefault(path, Tokens(path))
    data, offsets = arrays.string_bytes(column)
    for start, stop in arrays.chunks(offsets):
        part = offsets[start : stop + 1]
        found = tokens.encode(data[part[0] : part[-1]], part - part[0])
        stops = np.cumsum([len(one) for one in found])
        yield np.insert(np.concatenate(found), stops, end_id), np.concatenate([[0], stops + np.arange(1, len(found) + 1)])


def _narrow(path: str, end_id: int) -> np.dtype:
    """The type of written ids."""
    tokens = _tokens.get(path) or _tokens.setdefault(path, Tokens(path))
    return np.dtype("<u2" if max(tokens.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4")


_ENCODED = "doc_id long, tie long, ids binary, uses binary"


def encoded_ids(docs: DataFrame, path: str, end_id: int) -> tuple[DataFrame, np.ndarray]:
    """doc_id, tie and the ids of every text with the end id, written; and how often every id occurs in all documents.

    A task adds one row with its counts, so the vocabulary bounds what reaches the driver.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, total = _narrow(path, end_id), np.zeros(0, np.int64)
        names = ["doc_id", "tie", "ids", "uses"]
        for batch in batches:
            at = 0
            for ids, edges in _encoded(batch.column("text"), path, end_id):
                rows = batch.slice(at, len(edges) - 1)
                at += len(rows)
                more = np.bincount(ids, minlength=len(total))
                more[: len(total)] += total
                total = more
                offsets = pa.py_buffer((edges * kind.itemsize).astype(np.int64))
                packed = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, offsets, pa.py_buffer(ids.astype(kind))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("tie"), packed, pa.nulls(len(rows), pa.binary())], names=names)
        if len(total):
            nothing = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array([total.astype("<i8").tobytes()], pa.binary())], names=names)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column("uses").to_pylist():
                more = np.frombuffer(raw, "<i8")
                both = np.zeros(max(len(more), len(total)), np.int64)
                both[: len(total)] += total
                both[: len(more)] += more
                total = both
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "uses"])

    folder = shared_folder(docs.sparkSession, "token-ids")
    docs.mapInArrow(encode, _ENCODED).write.option("compression", "zstd").parquet(folder)
    written = docs.sparkSession.read.schema(_ENCODED).parquet(folder)
    uses = written.filter("uses IS NOT NULL").select("uses").mapInArrow(counted, "id long, uses long")
    rows = uses.groupBy("id").agg(F.sum("uses").alias("uses")).collect()
    counts = np.zeros(max((row.id for row in rows), default=-1) + 1, np.int64)
    for row in rows:
        counts[row.id] = row.uses
    return written.filter("ids IS NOT NULL").drop("uses"), counts


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for unused ids."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order]
    items, leaf_first = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        sorted_places = np.argsort(both, kind="stable")
        items = both[sorted_places]
        leaf_first.append(sorted_places < len(leaves))
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(leaf_first):
        chosen = int(is_leaf[:take].sum())
        lengths[order[:chosen]] += 1
        take = 2 * (take - chosen)
    return lengths


class Code:
    """Canonical codes: shorter ones first, then by id."""

    def __init__(self, lengths: np.ndarray, limit: int = LIMIT):
        self.limit, self.lengths = limit, lengths
        used = np.flatnonzero(lengths)
        self.order = used[np.argsort(lengths[used], kind="stable")]
        spans = 1 << (limit - lengths[self.order])
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[self.order] = (np.cumsum(spans) - spans) >> (limit - lengths[self.order])
        self._table: np.ndarray | None = None

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of the ids, and the offset of every STRIDE-th."""
        sizes, codes = self.lengths[ids], self.codes[ids]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        out = np.zeros(int(ends[-1] >> 6) + 2 if len(ids) else 1, np.uint64)
        word, room = starts >> 6, 64 - (starts & 63) - sizes
        high = np.where(room >= 0, codes << np.maximum(room, 0).astype(np.uint64), codes >> np.maximum(-room, 0).astype(np.uint64))
        firsts = np.flatnonzero(np.diff(word, prepend=-1))
        if len(ids):
            out[word[firsts]] = np.add.reduceat(high, firsts)
        over = np.flatnonzero(room < 0)
        out[word[over] + 1] += codes[over] << (64 + room[over]).astype(np.uint64)
        return out.astype(">u8").tobytes(), starts[::STRIDE]

    def unpack(self, packed: bytes, checkpoints: np.ndarray, count: int) -> np.ndarray:
        if not count:
            return np.zeros(0, np.int32)
        if self._table is None:
            self._table = np.repeat(self.order, 1 << (self.limit - self.lengths[self.order])).astype(np.int32)
            self._table = np.pad(self._table, (0, (1 << self.limit) - len(self._table)), mode="edge")
        bits = np.frombuffer(packed + bytes(4), np.uint8).astype(np.uint32)
        windows = (bits[:-3] << 24) | (bits[1:-2] << 16) | (bits[2:-1] << 8) | bits[3:]
        at = checkpoints.astype(np.int64)
        last = len(windows) * 8 - 1
        result = np.empty((min(STRIDE, count), len(at)), np.int32)
        shift, mask = 32 - self.limit, (1 << self.limit) - 1
        for step in range(len(result)):
            at = np.minimum(at, last)
            found = self._table[(windows[at >> 3] >> (shift - (at & 7)).astype(np.uint32)) & mask]
            result[step] = found
            at = at + self.lengths[found]
        return result.T.ravel()[:count] if len(at) == 1 else result.T.reshape(-1)[:count]


_BLOCKS = (
    "part int, block int, part_start long, doc_ids array<long>, sizes array<long>, bits binary, checkpoints array<long>"
)


def _block_writer(path: str, end_id: int, lengths: np.ndarray, limit: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, kind = Code(lengths, limit), TaskContext.get().partitionId(), _narrow(path, end_id)
        state = {"block": 0, "before": 0}
        ids: list[np.ndarray] = []
        names: list[int | None] = []

        def block() -> pa.RecordBatch:
            whole = np.concatenate(ids)
            bits, checkpoints = code.pack(whole)
            row = [part, state["block"], state["before"], list(names), [len(one) for one in ids], bits, checkpoints]
            state["block"] += 1
            state["before"] += len(whole)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays(
                [pa.array([value], kind) for value, kind in zip(row, kinds)],
                names=["part", "block", "part_start", "doc_ids", "sizes", "bits", "checkpoints"],
            )

        held = 0
        for batch in batches:
            for name, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                ids.append(np.frombuffer(raw, kind))
                names.append(name)
                held += len(ids[-1])
                if held >= BLOCK_IDS:
                    yield block()
                    ids.clear()
                    names.clear()
                    held = 0
        if ids:
            yield block()

    return write


def write_token_files(
    docs: DataFrame, folder: str, end_id: int, path: str | None = None, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text",
) -> None:
    """Encode all documents into ``folder``."""
    path = path or default_path()
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    encoded, counts = encoded_ids(texts.withColumn("tie", F.xxhash64("text")), path, end_id)
    lengths = code_lengths(counts, limit)
    used = np.flatnonzero(lengths)
    spark = docs.sparkSession
    book = spark.createDataFrame(list(zip(used.tolist(), lengths[used].tolist())), "id int, length int")
    book.coalesce(1).write.parquet(f"{folder}/codebook")
    ordered = encoded.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.mapInArrow(_block_writer(path, end_id, lengths, limit), _BLOCKS).write.parquet(f"{folder}/blocks")


def _block_reader(lengths: np.ndarray, limit: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths, limit)
        for batch in batches:
            for row in range(len(batch)):
                part, block, before, doc_ids, sizes, bits, checkpoints = (column[row].as_py() for column in batch.columns)
                ends = np.cumsum(sizes)
                ids = code.unpack(bits, np.array(checkpoints), int(ends[-1])).astype("<u4")
                raw = ids.tobytes()
                edges = [0, *(4 * ends).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(sizes), pa.int32()), pa.array(before + ends - sizes, pa.int64()), pa.array(doc_ids, pa.int64()),
                     pa.array([raw[a:b] for a, b in zip(edges, edges[1:])], pa.binary())],
                    names=["part", "start", "doc_id", "ids"],
                )

    return read


def read_token_files(spark: SparkSession, folder: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian 32-bit) of every document."""
    book = spark.read.parquet(f"{folder}/codebook").collect()
    lengths = np.zeros(max((row.id for row in book), default=-1) + 1, np.int64)
    for row in book:
        lengths[row.id] = row.length
    blocks = spark.read.parquet(f"{folder}/blocks")
    # a row for each part; parts are the tasks that wrote the files
    sizes = blocks.select("part", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b).alias("size")).groupBy("part").agg(F.sum("size").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    docs = blocks.mapInArrow(_block_reader(lengths, limit), "part int, start long, doc_id long, ids binary")
    return docs.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "ids")
