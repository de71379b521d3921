"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text is cut into words (blanks and what follows them); the words of a batch that
were not met before are segmented together.  Words of equal length advance letter
by letter; substring hashes probe the sorted keys of the vocabulary, and the
maximum over the piece lengths stores a backpointer.  The result maximises the sum
of piece scores; ties go to the longer last piece.  The file's scores are used
if they are logarithms; where they are merge ranks, Zipf's law over the order of
the pieces takes their place: tokenizers are never trained here.

Spaces become the visible blank and one is put before the text, as the file format
has it.  A letter in no piece is spelled in byte pieces, and so is a visible blank
of the text itself: decoding gives back every text exactly.  Null and empty texts
have no pieces and decode to the empty text.  A column of the result's name is
replaced; other columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gleaner.llm import arrays
from gleaner.llm.pieces import PLAIN_SPACE_MARK, SPACE, Lattice, Pieces, default_path, pieces

UNKNOWN = -30.0  # below every piece, so that bytes are the last resort
MOST_WORDS = 300_000  # segmented words a worker remembers


def segment(vocabulary: Pieces, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and how many each word has."""
    lattice = Lattice(vocabulary, values, starts, ends)
    scores = np.append(vocabulary.scores, -np.inf)
    found: list[tuple[np.ndarray, np.ndarray]] = []  # places and ids
    for _, length, places in lattice.by_length():
        rows = len(places)
        best, back = np.full((length + 1, rows), -np.inf), np.zeros((length + 1, rows), np.int64)
        best[0] = 0
        for end in range(1, length + 1):
            for size in range(min(end, vocabulary.longest), 0, -1):
                hit = lattice.hits[size - 1][places + end - size]
                score = best[end - size] + scores[hit]
                if size == 1:
                    score = np.where(hit < 0, best[end - 1] + UNKNOWN, score)
                better = score > best[end]
                best[end] = np.where(better, score, best[end])
                back[end] = np.where(better, size, back[end])
        at, alive = np.full(rows, length), np.arange(rows)
        while len(alive):
            size = back[at[alive], alive]
            at[alive] -= size
            begins = places[alive] + at[alive]
            hit = np.full(len(alive), -1)
            for one in np.unique(size):
                chosen = size == one
                hit[chosen] = lattice.hits[one - 1][begins[chosen]]
            found.append((begins, hit))
            alive = alive[at[alive] > 0]
    if not found:
        return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
    begins, hit = np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
    order = np.argsort(begins)
    begins, hit = begins[order], hit[order]
    known = np.where(hit >= 0, vocabulary.ids[hit], -1)
    # a letter without a piece becomes the byte pieces of its UTF-8 form
    lost = np.flatnonzero(hit < 0)
    spelled = [np.frombuffer((chr(v) if v != PLAIN_SPACE_MARK else "▁").encode(), np.uint8) for v in values[begins[lost]].tolist()]
    widths = np.ones(len(hit), np.int64)
    widths[lost] = [len(one) for one in spelled]
    ids = np.repeat(known, widths)
    if len(lost):
        ids[arrays.ranges((np.cumsum(widths) - widths)[lost], widths[lost])] = vocabulary.byte_ids[np.concatenate(spelled)]
    word = np.searchsorted(starts, begins, "right") - 1
    return ids.astype(np.int32), np.bincount(word, weights=widths, minlength=len(starts)).astype(np.int64)


class Encoder:
    """Encodes batches of texts and remembers the words it has segmented."""

    def __init__(self, path: str):
        self.vocabulary = pieces(path)
        self.words = arrays.Remembered(MOST_WORDS)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets of the texts in them."""
        points, places = arrays.code_points(data, offsets)
        filled = (places[1:] > places[:-1]).astype(np.int64)
        shift = np.concatenate([[0], np.cumsum(filled)])
        edges = places + shift  # with a blank before every text that isn't empty
        values = np.full(edges[-1], SPACE, np.uint32)
        inner = np.ones(len(values), bool)
        inner[edges[:-1][filled > 0]] = False
        values[inner] = np.where(points == 32, SPACE, np.where(points == SPACE, PLAIN_SPACE_MARK, points))
        blank = values == SPACE
        firsts = blank & ~np.concatenate([[False], blank[:-1]])
        firsts[edges[:-1][filled > 0]] = True
        starts = np.flatnonzero(firsts)
        ends = np.append(starts[1:], len(values)) if len(starts) else starts

        def work_out(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            begins, lengths = starts[places], (ends - starts)[places]
            edges = np.cumsum(lengths)
            return segment(self.vocabulary, values[arrays.ranges(begins, lengths)], edges - lengths, edges)

        ids, counts = self.words.look_up(values, np.append(starts, len(values)), work_out)
        return ids, np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, edges)]


def decode_ids(vocabulary: Pieces, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The texts of runs of ids."""
    widths = np.array([len(one) for one in vocabulary.text_of])
    flat = np.frombuffer(b"".join(vocabulary.text_of), np.uint8)
    places = np.concatenate([[0], np.cumsum(widths[ids])])[offsets]
    whole = flat[arrays.ranges((np.cumsum(widths) - widths)[ids], widths[ids])].tobytes()
    # the first byte is the blank that was put before the text
    return [whole[a + 1 : b].decode("utf-8") for a, b in zip(places[:-1].tolist(), places[1:].tolist())]


def _carried(frame: DataFrame, column: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    rest = frame.drop(column)
    return rest, T.StructType([*rest.schema.fields, T.StructField(column, kind)])


def encode(docs: DataFrame, text_column: str = "text", ids_column: str = "pieces", path: str | None = None) -> DataFrame:
    """``docs`` with the piece ids of every text as an array of ints."""
    path = path or default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            data, offsets = arrays.string_bytes(batch.column(text_column))
            for start, stop in arrays.chunks(offsets):
                part = offsets[start : stop + 1]
                ids, places = encoder.encode(data[part[0] : part[-1]], part - part[0])
                column = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(ids, pa.int32()))
                rows = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*rows.columns, column], names=[*batch.schema.names, ids_column])

    rest, schema = _carried(docs, ids_column, T.ArrayType(T.IntegerType()))
    return rest.mapInArrow(work, schema)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def decode(frame: DataFrame, ids_column: str = "pieces", text_column: str = "decoded", path: str | None = None) -> DataFrame:
    """``frame`` with the text that the ids spell; null ids give a null text."""
    path = path or default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        for batch in batches:
            column = batch.column(ids_column)
            lengths = np.array([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
            ids = column.flatten().to_numpy(zero_copy_only=False)
            texts = decode_ids(vocabulary, ids, np.concatenate([[0], np.cumsum(lengths)]))
            texts = [text if valid else None for text, valid in zip(texts, column.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_column])

    rest, schema = _carried(frame, text_column, T.StringType())
    return rest.mapInArrow(work, schema)
