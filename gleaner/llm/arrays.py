"""Whole Arrow batches of text as numpy arrays: code points, slices and substring hashes.

The hash of values v[a:b] is mix(sum of f(v[i]) * B^(i-a)) modulo 2^64 for an odd
B, taken from one running sum per batch, so that any number of substrings is
hashed without a Python loop.  Some long words of one length share such a hash, so it
only finds what is then compared; ``distinct`` and ``Remembered`` tell words apart.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 19


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@functools.cache
def _letters() -> np.ndarray:
    return mixed(np.arange(1, 0x110002, dtype=np.uint64))


_powers: list[np.ndarray] = []


def _powers_to(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < size:
        room = max(size, CHUNK_BYTES + 1)
        ups, downs = np.full(room, _BASE, np.uint64), np.full(room, _BACK, np.uint64)
        ups[0] = downs[0] = 1
        _powers[:] = [np.cumprod(ups, dtype=np.uint64), np.cumprod(downs, dtype=np.uint64)]
    return _powers[0], _powers[1]


class Substrings:
    """Hashes of any substrings of one array of code points or bytes."""

    def __init__(self, values: np.ndarray):
        ups, self._downs = _powers_to(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(_letters()[values] * ups[: len(values)], out=self._sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self._sums[ends] - self._sums[starts]) * self._downs[starts])


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and the offsets of its rows; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes, or of one longer row."""
    start = 0
    while start < len(offsets) - 1:
        stop = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        stop = min(max(stop, start + 1), len(offsets) - 1)
        yield start, stop
        start = stop


def code_points(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the offsets of the rows in them.

    With ``lower`` all is lower-cased first; texts are joined for that by a line
    break, which is then part of the row before it.
    """
    if not lower:
        firsts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        return points, firsts[offsets]
    raw = data.tobytes()
    texts = [raw[a:b].decode("utf-8").lower() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    places = np.concatenate([[0], np.cumsum([len(text) + 1 for text in texts], dtype=np.int64)])
    return np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), "<u4"), places


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return edges[0::2], edges[1::2]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + length) one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


def distinct(values: np.ndarray, edges: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words as bytes, where each occurs first, and the number of every word's.

    Words lie one after another and are told apart by what they hold; ``edges`` has the
    start of every word and the end of the last.
    """
    offsets = pa.py_buffer(np.ascontiguousarray(edges * values.itemsize, np.int64))
    words = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])
    coded = words.dictionary_encode()
    numbers = coded.indices.to_numpy()
    first = np.empty(len(coded.dictionary), np.int64)
    first[numbers[::-1]] = np.arange(len(numbers) - 1, -1, -1)
    return coded.dictionary.to_pylist(), first, numbers


class Growing:
    """An array that grows at its end; room is doubled, so adding costs what is added."""

    def __init__(self, kind):
        self._all, self.size = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        while self.size + len(values) > len(self._all):
            self._all = np.concatenate([self._all, np.zeros_like(self._all)])
        self._all[self.size : self.size + len(values)] = values
        self.size += len(values)

    @property
    def values(self) -> np.ndarray:
        return self._all[: self.size]


def _differing(values: np.ndarray, starts: np.ndarray, others: np.ndarray, other_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of some words in ``values`` aren't the words of the same lengths in ``others``."""
    unlike = values[ranges(starts, lengths)] != others[ranges(other_starts, lengths)]
    word = np.zeros(len(lengths), bool)
    word[np.searchsorted(np.cumsum(lengths), np.flatnonzero(unlike), "right")] = True
    return word


class Remembered:
    """Ids of words, so that a worker works each word out once.

    Words are found by a hash and then compared; of several words with one hash only
    the first is held, and the others are worked out whenever they come.  At most about
    ``most`` words are held; then all are forgotten.
    """

    def __init__(self, most: int):
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.sorted, self.recent = ([np.zeros(0, np.uint64), np.zeros(0, np.int64)] for _ in range(2))
        self.counts, self.begins, self.lengths, self.places = (Growing(np.int64) for _ in range(4))
        self.ids, self.points = Growing(np.int32), Growing(np.uint32)

    def full(self) -> bool:
        """Whether all words will be forgotten before the next ones are looked up."""
        return self.counts.size > self.most

    def _add(self, words: tuple[np.ndarray, np.ndarray, np.ndarray], found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        values, starts, lengths = words
        ids, counts = found
        rows = self.counts.size + np.arange(len(counts))
        self.begins.add(self.ids.size + np.cumsum(counts) - counts)
        self.places.add(self.points.size + np.cumsum(lengths) - lengths)
        self.counts.add(counts)
        self.lengths.add(lengths)
        self.ids.add(ids)
        self.points.add(values[ranges(starts, lengths)])
        return rows

    def _remember(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Add sorted keys to the recent ones, which join the others when they are many."""
        places = np.searchsorted(self.recent[0], keys)
        self.recent = [np.insert(self.recent[0], places, keys), np.insert(self.recent[1], places, rows)]
        if len(self.recent[0]) > max(1 << 15, len(self.sorted[0]) // 4):
            both = [np.concatenate(pair) for pair in zip(self.sorted, self.recent)]
            order = np.argsort(both[0], kind="stable")
            self.sorted = [one[order] for one in both]
            self.recent = [np.zeros(0, np.uint64), np.zeros(0, np.int64)]

    def look_up(self, values: np.ndarray, edges: np.ndarray, work_out) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another and how many each has.

        Words lie one after another between ``edges``; ``work_out`` gives ids and counts
        of the words whose numbers it is handed.
        """
        starts, lengths = edges[:-1], np.diff(edges)
        inverse, keys = pd.factorize(Substrings(values).hashes(starts, edges[1:]))
        first = np.empty(len(keys), np.int64)
        first[inverse[::-1]] = np.arange(len(starts) - 1, -1, -1)
        if self.full():
            self._forget()
        rows = np.full(len(keys), -1)
        for known, row_of in (self.sorted, self.recent):
            if len(known):
                places = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                rows = np.where(known[places] == keys, row_of[places], rows)
        held = rows >= 0
        # held under this hash, but another word?
        known = np.flatnonzero(held)
        fits = lengths[first[known]] == self.lengths.values[rows[known]]
        known, unlike = known[fits], known[~fits]
        other = _differing(values, starts[first[known]], self.points.values, self.places.values[rows[known]], lengths[first[known]])
        strange = np.concatenate([unlike, known[other]])
        new = np.flatnonzero(~held)
        new = new[np.argsort(keys[new])]
        fresh = np.sort(np.concatenate([new, strange]))
        if len(fresh):
            at = first[fresh]
            rows[fresh] = self._add((values, starts[at], lengths[at]), work_out(at))
            self._remember(keys[new], rows[new])
        rows = rows[inverse]
        # words of this batch that share a hash with an earlier one of it, but aren't that word
        again = np.flatnonzero(first[inverse] != np.arange(len(starts)))
        leader = first[inverse[again]]
        same = lengths[again] == lengths[leader]
        other = _differing(values, starts[again[same]], values, starts[leader[same]], lengths[again[same]])
        odd = np.sort(np.concatenate([again[~same], again[same][other]]))
        if len(odd):
            rows[odd] = self._add((values, starts[odd], lengths[odd]), work_out(odd))
        counts = self.counts.values[rows]
        return self.ids.values[ranges(self.begins.values[rows], counts)], counts


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 on in groups of seven bits, the last group below 128, and how many bytes each takes."""
    values = np.asarray(values, np.int64)
    sizes = np.ones(len(values), np.int64)
    rest = values >> 7
    while rest.any():
        sizes += rest > 0
        rest = rest >> 7
    out = np.empty(int(sizes.sum()), np.uint8)
    begins = np.cumsum(sizes) - sizes
    for step in range(int(sizes.max(initial=0))):
        chosen = np.flatnonzero(sizes > step)
        more = (sizes[chosen] > step + 1).astype(np.int64) << 7
        out[begins[chosen] + step] = (values[chosen] >> (7 * step)) & 127 | more
    return out, sizes


def from_varints(data: bytes) -> np.ndarray:
    """The numbers of ``varints``."""
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    stops = np.flatnonzero(raw < 128)
    begins = np.concatenate([[0], stops[:-1] + 1])[: len(stops)]
    values = raw[stops].copy()
    for step in range(1, int((stops - begins).max(initial=0)) + 1):
        chosen = np.flatnonzero(stops - begins >= step)
        values[chosen] = values[chosen] << 7 | raw[stops[chosen] - step] & 127
    return values
