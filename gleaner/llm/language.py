"""Language identification with segmentation-marginalised unigrams.

The vocabulary is a public piece file.  Each language has a probability for every
piece; the probability of a word is the sum over all ways to cut it into pieces,
found by a forward algorithm, and a text scores the product over its words.  Words
are runs of letters of the lower-cased text with the visible blank before them; a
run may have any length; only in training, runs of over ``LONGEST`` letters are cut.

Training is expectation maximisation of the piece probabilities, run as Spark jobs
on a bounded sample: about ``sample_rows`` labelled rows of each language (all rows
where there are fewer), chosen by a hash of id and text, so that copies of a text under
ids of their own are drawn one by one.  What reaches the driver are expected counts:
vocabulary size times number of languages.

Predictions read whole texts and nothing else.  The prior is uniform; ``score`` is
the posterior of the language that is returned, and ties go to the first name.  A
text that is null or has no letter, or any text if no language was learned, gets
``und`` and score 0.  Columns of the results' names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm import arrays
from gleaner.llm.pieces import SPACE, Lattice, Pieces, default_path, pieces
from gleaner.session import written

UNDETERMINED = "und"
SAMPLE_ROWS = 3_000
STEPS = 2
LONGEST = 64  # letters of a word in training
RESCALED = 64
SMOOTHING = 0.05
UNKNOWN = 1e-9  # probability of a letter that is no piece, in every language
_LIFT = 40.0  # each letter's factor that keeps products of probabilities in range
MOST_WORDS = 600_000  # words a worker remembers

_alphabetic: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _alphabetic:
        _alphabetic.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _alphabetic[0][points]


def words_of(data: np.ndarray, offsets: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters with a blank before each word, starts and ends of words, first word of each text.

    With ``longest`` longer words are cut into such lengths.
    """
    points, places = arrays.code_points(data, offsets, lower=True)
    starts, ends = arrays.runs(_is_letter(points))
    if longest:
        slices = np.maximum(-(-(ends - starts) // longest), 1)
        nth = arrays.ranges(np.zeros(len(slices), np.int64), slices)
        starts, ends = np.repeat(starts, slices) + nth * longest, np.repeat(ends, slices)
        ends = np.minimum(ends, starts + longest)
    lengths = ends - starts
    edges = np.cumsum(lengths + 1)
    values = np.full(int(edges[-1]) if len(edges) else 0, SPACE, np.uint32)
    values[arrays.ranges(edges - lengths, lengths)] = points[arrays.ranges(starts, lengths)]
    return values, edges - lengths - 1, edges, np.searchsorted(starts, places)


def word_logs(vocabulary: Pieces, chances: np.ndarray, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """log P(word | language), a row per word."""
    lattice = Lattice(vocabulary, values, starts, ends)
    chances = np.vstack([chances * 1.0, np.zeros((1, chances.shape[1]))])
    logs = np.zeros((len(starts), chances.shape[1]))
    for numbers, length, places in lattice.by_length():
        np.add.at(logs, lattice.word[numbers], _log_sums(vocabulary, lattice, chances, length, places))
    return logs


def _log_sums(vocabulary: Pieces, lattice: Lattice, chances: np.ndarray, length: int, places: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over all segmentations.

    Only the sums that the longest piece can reach back to are held, and they are
    brought back to range every ``RESCALED`` letters, so words may have any length.
    """
    recent, scale = [np.ones((len(places), chances.shape[1]))], 0.0
    for end in range(1, length + 1):
        total = 0.0
        for size in range(1, min(end, vocabulary.longest) + 1):
            hit = lattice.hits[size - 1][places + end - size]
            if size > 1 and not (hit >= 0).any():
                continue
            step = chances[hit]
            if size == 1:
                step = np.where((hit < 0)[:, None], UNKNOWN, step)
            total = total + recent[-size] * step * _LIFT**size
        recent = [*recent[-vocabulary.longest + 1 :], total] if vocabulary.longest > 1 else [total]
        if end % RESCALED == 0 and end < length:
            scale = scale + np.log(total)
            recent = [one / total for one in recent]
    return np.log(recent[-1]) + scale - length * np.log(_LIFT)


def _forward(vocabulary: Pieces, lattice: Lattice, chances: np.ndarray, length: int, places: np.ndarray) -> list[np.ndarray]:
    """Sums over all segmentations of the first letters, lifted by a factor per letter."""
    sums = [np.ones((len(places), chances.shape[1]))]
    for end in range(1, length + 1):
        total = 0.0
        for size in range(1, min(end, vocabulary.longest) + 1):
            hit = lattice.hits[size - 1][places + end - size]
            step = chances[hit]
            if size == 1:
                step = np.where((hit < 0)[:, None], UNKNOWN, step)
            elif not (hit >= 0).any():
                continue
            total = total + sums[end - size] * step * _LIFT**size
        sums.append(total)
    return sums


def expected_counts(vocabulary: Pieces, chances: np.ndarray, values, starts, ends, weights: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language, for words with weights per language."""
    lattice = Lattice(vocabulary, values, starts, ends)
    wide = np.vstack([chances, np.zeros((1, chances.shape[1]))])
    counts = np.zeros_like(chances)
    for numbers, length, places in lattice.by_length():
        before = _forward(vocabulary, lattice, wide, length, places)
        share = weights[lattice.word[numbers]] / before[length]
        after = [np.zeros(0)] * length + [np.ones_like(before[0])]
        for begin in range(length - 1, -1, -1):
            total = 0.0
            for size in range(1, min(length - begin, vocabulary.longest) + 1):
                hit = lattice.hits[size - 1][places + begin]
                step = wide[hit]
                if size == 1:
                    step = np.where((hit < 0)[:, None], UNKNOWN, step)
                elif not (hit >= 0).any():
                    continue
                passed = step * _LIFT**size * after[begin + size]
                total = total + passed
                used = np.flatnonzero(hit >= 0)
                for language in range(chances.shape[1]):
                    gain = before[begin][used, language] * passed[used, language] * share[used, language]
                    counts[:, language] += np.bincount(hit[used], weights=gain, minlength=len(counts))
            after[begin] = total
    return counts


@dataclass(frozen=True)
class Model:
    path: str
    languages: list[str]
    chances: np.ndarray  # a row per piece, a column per language


def train(
    docs: DataFrame, text_column: str = "text", language_column: str = "lang", sample_rows: int = SAMPLE_ROWS,
    path: str | None = None, steps: int = STEPS, id_column: str = "doc_id",
) -> Model:
    """Fit the piece probabilities to the labelled rows of ``docs``."""
    path = path or default_path()
    labelled = docs.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"), F.col(f"`{language_column}`").alias("lang")
    ).dropna(subset=["text", "lang"])
    sizes = labelled.groupBy("lang").count()
    # a hash of id and text below the share that is wanted of its language
    share = F.lit(float(sample_rows)) / F.col("count") * (1 << 30)
    sample = written(
        labelled.join(F.broadcast(sizes), "lang").filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < share).select("text", "lang"), "labelled"
    )
    languages = sorted(row.lang for row in sizes.select("lang").collect())
    vocabulary = pieces(path)
    rank = np.argsort(np.argsort(vocabulary.ids)) + 2.0
    chances = np.repeat((1 / rank / (1 / rank).sum())[:, None], max(len(languages), 1), axis=1)
    for _ in range(steps if languages else 0):
        counts = np.zeros_like(chances)
        spread = sample.mapInArrow(_count_with(path, languages, chances), "language int, piece int, uses double")
        for row in spread.groupBy("language", "piece").agg(F.sum("uses").alias("uses")).collect():
            counts[row.piece, row.language] = row.uses
        chances = (counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * len(counts))
    return Model(path, languages, chances)


def _count_with(path: str, languages: list[str], chances: np.ndarray):
    number = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        total = np.zeros_like(chances)
        for batch in batches:
            data, offsets = arrays.string_bytes(batch.column("text"))
            label = np.array([number[name] for name in batch.column("lang").to_pylist()], np.int64)
            for start, stop in arrays.chunks(offsets):
                part = offsets[start : stop + 1]
                values, starts, ends, first = words_of(data[part[0] : part[-1]], part - part[0], LONGEST)
                words, place, inverse = arrays.distinct(values, np.append(starts, len(values)))
                weights = np.zeros((len(words), len(languages)))
                np.add.at(weights, (inverse, np.repeat(label[start:stop], np.diff(first))), 1)
                lengths = ends[place] - starts[place]
                edges = np.cumsum(lengths)
                flat = values[arrays.ranges(starts[place], lengths)]
                total += expected_counts(vocabulary, chances, flat, edges - lengths, edges, weights)
        piece, language = np.nonzero(total > 1e-6)
        yield pa.RecordBatch.from_arrays(
            [pa.array(language, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[piece, language])], names=["language", "piece", "uses"]
        )

    return count


class _Scorer:
    """Scores batches of texts and remembers the words it has met."""

    def __init__(self, model: Model):
        self.model, self.vocabulary = model, pieces(model.path)
        self._forget()

    def _forget(self) -> None:
        self.words, self.logs = arrays.Remembered(MOST_WORDS), arrays.Growing(np.float64)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Has a letter, number of the best language, its posterior; for each text."""
        values, starts, ends, first = words_of(data, offsets)
        width = len(self.model.languages)
        if self.words.full():
            self._forget()

        def work_out(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            lengths = (ends - starts)[places]
            edges = np.cumsum(lengths)
            flat = values[arrays.ranges(starts[places], lengths)]
            row = self.logs.size // width
            self.logs.add(word_logs(self.vocabulary, self.model.chances, flat, edges - lengths, edges).ravel())
            return np.arange(row, row + len(places), dtype=np.int32), np.ones(len(places), np.int64)

        # what is remembered of a word is the row of its logarithms
        rows, _ = self.words.look_up(values, np.append(starts, len(values)), work_out)
        logs = self.logs.values.reshape(-1, width)[rows]
        sums = np.vstack([np.zeros((1, logs.shape[1])), np.cumsum(logs, axis=0)])
        texts = sums[first[1:]] - sums[first[:-1]]
        best = texts.argmax(axis=1)
        posterior = 1 / np.exp(texts - texts[np.arange(len(texts)), best][:, None]).sum(axis=1)
        return first[1:] > first[:-1], best, posterior


def identify(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    rest = docs.drop("lang_pred", "score")
    schema = T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            names, scores = [], []
            data, offsets = arrays.string_bytes(batch.column(text_column))
            for start, stop in arrays.chunks(offsets) if model.languages else ():
                part = offsets[start : stop + 1]
                lettered, best, posterior = scorer.score(data[part[0] : part[-1]], part - part[0])
                names += [model.languages[i] if filled else UNDETERMINED for filled, i in zip(lettered.tolist(), best.tolist())]
                scores += np.where(lettered, np.round(posterior, 6), 0.0).tolist()
            if not model.languages:
                names, scores = [UNDETERMINED] * len(batch), [0.0] * len(batch)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"]
            )

    return rest.mapInArrow(work, schema)


def held_out(id_column: Column) -> Column:
    """Rows kept from training: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))
