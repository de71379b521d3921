"""Runs of repeated words: stretches that continue a period, found by branching squares.

The words of a batch of documents are numbered and their suffixes sorted by prefix
doubling, each document for itself.  For every interval of suffixes that share
exactly ``depth`` words, the suffixes of all children but the largest are looked
at: suffix i begins (or i - depth begins) a square that can't be shifted to the
right if the inverse suffix array puts i + depth (i - depth) into another child of
the same interval.  Such a square is the last one of a run; it is rotated to the
left as far as words agree, by the ranks of the doubling rounds, and squares of one
stretch are merged into a run of its smallest period.  No tree is built: intervals
come from one pass with a stack over the common lengths.

A run is a maximal stretch of at least ``least`` words and two periods.  Every such
stretch has a square whose root has more than ``least / 4`` words and is a multiple
of its period, so shallower intervals aren't looked at.

A word is any text without blanks and line breaks of ASCII.  Null and empty texts
have no words and no runs; equal documents give equal rows.  A document's words are
held by one task, in about 100 bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gleaner.llm import arrays

LEAST_WORDS = 12
_CANDIDATES = 1 << 20  # suffixes looked at together

_RUN = T.StructType([T.StructField(name, T.LongType(), False) for name in ("start", "length", "period")])
_RUNS = T.ArrayType(_RUN, False)


class Suffixes:
    """Sorted suffixes of documents that lie one after another; words of two documents never have the same key."""

    def __init__(self, keys: np.ndarray, ends: np.ndarray):
        """``ends`` holds for each word the end of its document."""
        count = len(keys)
        order = np.argsort(keys, kind="stable")
        rank = self._ranks(order, keys[order], np.zeros(count, np.int64), count)
        self.levels = [np.append(rank, -1).astype(np.int32)]
        open_ = self._open(order, rank)
        width = 1
        while len(open_):
            beyond = open_ + width
            second = np.where(beyond < ends[open_], rank[np.minimum(beyond, count - 1)], -1)
            both = rank[open_] * (count + 1) + second + 1
            sort = np.argsort(both, kind="stable")
            moved, both = open_[sort], both[sort]
            # open suffixes keep the places of their group
            slots = rank[moved] + self._within(rank[moved])
            order[slots] = moved
            first = np.concatenate([[True], both[1:] != both[:-1]])
            rank = rank.copy()
            rank[moved] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
            self.levels.append(np.append(rank, -1).astype(np.int32))
            open_ = moved[self._repeated(rank[moved])]
            width *= 2
        self.order, self.place = order, np.append(rank, -1)

    @staticmethod
    def _within(groups: np.ndarray) -> np.ndarray:
        """The number of each element inside its run of equal values."""
        at = np.arange(len(groups))
        first = np.concatenate([[True], groups[1:] != groups[:-1]])
        return at - np.maximum.accumulate(np.where(first, at, 0))

    @staticmethod
    def _repeated(values: np.ndarray) -> np.ndarray:
        same = values[1:] == values[:-1]
        return np.concatenate([same, [False]]) | np.concatenate([[False], same])

    @staticmethod
    def _ranks(order: np.ndarray, keys: np.ndarray, out: np.ndarray, count: int) -> np.ndarray:
        first = np.concatenate([[True], keys[1:] != keys[:-1]])[:count]
        out[order] = np.maximum.accumulate(np.where(first, np.arange(count), 0))
        return out

    def _open(self, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return order[self._repeated(rank[order])] if len(order) else order

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes a and b (of different places) have in common."""
        at, other = a.copy(), b.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][at] == self.levels[k][other]) * (1 << k)
            at += step
            other += step
        return at - a

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before the places a < b agree."""
        at, apart = a.copy(), b - a
        for k in range(len(self.levels) - 1, -1, -1):
            back = at - (1 << k)
            inside = np.maximum(back, 0)
            at = np.where((back >= 0) & (self.levels[k][inside] == self.levels[k][inside + apart]), back, at)
        return a - at

    def shared(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the order whose suffix has ``least`` words in common with the one before, and how many."""
        level = self.levels[least.bit_length() - 1] if least.bit_length() <= len(self.levels) else None
        if level is None or len(self.order) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sorted_ = level[self.order]
        places = 1 + np.flatnonzero(sorted_[1:] == sorted_[:-1])
        depths = self.common(self.order[places - 1], self.order[places])
        return places[depths >= least], depths[depths >= least]


def _intervals(places: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Depth, first and last place of each interval, how many inner borders it has, and all borders."""
    depth_of, left_of, right_of, sizes, borders = [], [], [], [], []
    stack: list[tuple[int, int, list[int]]] = []
    last = -1

    def close(place: int, depth: int) -> int:
        left = place - 1
        while stack and depth < stack[-1][0]:
            found, left, cuts = stack.pop()
            depth_of.append(found)
            left_of.append(left)
            right_of.append(place - 1)
            sizes.append(len(cuts))
            borders.extend(cuts)
        return left

    for place, depth in zip(places.tolist(), depths.tolist()):
        if place != last + 1:
            close(last + 1, 0)
        left = close(place, depth)
        if stack and stack[-1][0] == depth:
            stack[-1][2].append(place)
        else:
            stack.append((depth, left, [place]))
        last = place
    close(last + 1, 0)
    return tuple(np.array(one, np.int64) for one in (depth_of, left_of, right_of, sizes, borders))


def branching_squares(suffixes: Suffixes, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and root lengths of the squares whose root has ``least`` words and that can't be shifted to the right."""
    depth, left, right, inner, borders = _intervals(*suffixes.shared(least))
    if not len(depth):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # children: from the left end or a border to the next border or the right end
    interval = np.repeat(np.arange(len(depth)), inner + 1)
    firsts = np.cumsum(inner + 1) - inner - 1
    begins = np.empty(len(interval), np.int64)
    begins[firsts] = left
    is_first = np.zeros(len(interval), bool)
    is_first[firsts] = True
    begins[~is_first] = borders
    stops = np.empty(len(interval), np.int64)
    is_last = np.append(is_first[1:], True)
    stops[is_last] = right + 1
    stops[~is_last] = borders
    sizes = stops - begins
    largest = np.flatnonzero(sizes == np.maximum.reduceat(sizes, firsts)[interval])
    largest = largest[np.unique(interval[largest], return_index=True)[1]]
    small = np.ones(len(interval), bool)
    small[largest] = False
    interval, begins, stops, sizes = interval[small], begins[small], stops[small], sizes[small]
    starts, roots = [], []
    groups = np.cumsum(sizes) // _CANDIDATES
    for group in np.unique(groups):
        chosen = np.flatnonzero(groups == group)
        child = np.repeat(chosen, sizes[chosen])
        at = suffixes.order[arrays.ranges(begins[chosen], sizes[chosen])]
        of, root = interval[child], depth[interval[child]]
        for square, other in ((at, at + root), (at - root, at - root)):
            place = np.where(other >= 0, suffixes.place[np.maximum(other, 0)], -1)
            hit = (place >= left[of]) & (place <= right[of]) & ((place < begins[child]) | (place >= stops[child]))
            starts.append(square[hit])
            roots.append(root[hit])
    return np.concatenate(starts), np.concatenate(roots)


def find_runs(keys: np.ndarray, ends: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs, by start and then period."""
    suffixes = Suffixes(keys, ends)
    shortest = least // 4 + 1
    squares, period = branching_squares(suffixes, shortest)
    stops = squares + 2 * period
    starts = squares - suffixes.common_before(squares, squares + period)
    for small in range(min(shortest, len(keys)) - 1, 0, -1):
        fits = np.flatnonzero(period % small == 0)
        if len(fits):
            agree = np.concatenate([[0], np.cumsum(keys[small:] == keys[:-small])])
            fits = fits[agree[stops[fits] - small] - agree[starts[fits]] == stops[fits] - small - starts[fits]]
            period[fits] = small
    order = np.lexsort((period, stops, starts))
    starts, stops, period = starts[order], stops[order], period[order]
    # of one stretch only the smallest period
    new = np.concatenate([[True], (starts[1:] != starts[:-1]) | (stops[1:] != stops[:-1])])[: len(starts)]
    kept = np.flatnonzero(new & (stops - starts >= np.maximum(least, 2 * period)))
    kept = kept[np.lexsort((period[kept], starts[kept]))]
    return starts[kept], stops[kept], period[kept]


def _chunk(texts: list[bytes], least: int) -> tuple[pa.Array, pa.Array]:
    """The runs and the text without repeats of some documents."""
    words = [text.split() for text in texts]  # of bytes: blanks and line breaks of ASCII
    sizes = np.array([len(one) for one in words], np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    coded = pa.array([word for one in words for word in one], pa.large_binary()).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    keys = np.repeat(np.arange(len(words)), sizes) * max(len(coded.dictionary), 1) + codes
    starts, stops, period = find_runs(keys, np.repeat(edges[1:], sizes), least)
    owner = np.searchsorted(edges, starts, "right") - 1
    change = np.zeros(len(keys) + 1, np.int64)
    np.add.at(change, starts + period, 1)
    np.add.at(change, stops, -1)
    stays = np.cumsum(change)[:-1] == 0
    texts_out = []
    for row in range(len(words)):
        kept = stays[edges[row] : edges[row + 1]]
        one = words[row] if kept.all() else [words[row][i] for i in np.flatnonzero(kept).tolist()]
        texts_out.append(b" ".join(one))
    fields = [pa.array(one, pa.int64()) for one in (starts - edges[owner], stops - starts, period)]
    offsets = np.searchsorted(owner, np.arange(len(words) + 1))
    flat = pa.StructArray.from_arrays(fields, fields=[pa.field(f.name, pa.int64(), False) for f in _RUN])
    kind = pa.list_(pa.field("element", flat.type, False))
    listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, type=kind)
    return listed, pa.array(texts_out, pa.binary()).cast(pa.string())


def periodic_runs(docs: DataFrame, text_column: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with ``runs``, by start and then period, and ``collapsed``.

    ``runs`` holds start (number of the word, from 0), length and period in words;
    ``collapsed`` is the text without what follows the first period of any run, its
    words joined by one space (null texts give the empty text).  Columns of these
    names are replaced, others are carried.
    """
    rest = docs.drop("runs", "collapsed") if text_column not in ("runs", "collapsed") else docs
    fields = [field for field in rest.schema.fields if field.name not in ("runs", "collapsed")]
    schema = T.StructType([*fields, T.StructField("runs", _RUNS), T.StructField("collapsed", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrays.string_bytes(batch.column(text_column))
            carried = [batch.column(field.name) for field in fields]
            raw = data.tobytes()
            for start, stop in arrays.chunks(offsets):
                bounds = offsets[start : stop + 1].tolist()
                found = _chunk([raw[a:b] for a, b in zip(bounds, bounds[1:])], least)
                rows = [column.slice(start, stop - start) for column in carried]
                yield pa.RecordBatch.from_arrays([*rows, *found], names=schema.names)

    return rest.mapInArrow(work, schema)
