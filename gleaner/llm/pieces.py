"""A public piece vocabulary and the lattice of its pieces over many words at once.

Pieces are found by hash: every substring of up to the longest piece's length is
hashed from running sums and looked up among the sorted hashes of the pieces; hits
are compared code point by code point.  Between two letters that no piece spans
words fall into segments, and segments of equal length advance together.
"""

from __future__ import annotations

import functools

import numpy as np

from gleaner.llm import arrays

SPACE = 0x2581  # the visible blank that stands for a space in pieces
PLAIN_SPACE_MARK = 0x110000  # the same character where a text itself holds it; in no piece


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The ordinary pieces of a SentencePiece file, its byte pieces and scores."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        self.byte_ids = np.full(256, -1, np.int64)
        self.text_of: list[bytes] = [b""] * size
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_ids[int(name[1:-1], 16)] = i
                self.text_of[i] = bytes([int(name[1:-1], 16)])
            elif not special[i]:
                self.text_of[i] = name.replace("▁", " ").encode()
        ids = [i for i in range(size) if not special[i] and not model.is_byte(i)]
        self.longest = max(len(names[i]) for i in ids)
        flat = np.frombuffer("".join(names[i] for i in ids).encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(names[i]) for i in ids])
        starts = ends - [len(names[i]) for i in ids]
        keys = arrays.Substrings(flat).hashes(starts, ends)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(ids)[order]
        # most substrings are no piece: the leading bits of their hashes tell at once
        self.leading = np.zeros(1 << 20, bool)
        self.leading[self.keys >> np.uint64(44)] = True
        self.points = np.zeros((len(ids), self.longest), np.uint32)
        for row, place in enumerate(order):
            self.points[row, : ends[place] - starts[place]] = flat[starts[place] : ends[place]]
        scores = np.array([model.get_score(int(i)) for i in self.ids])
        if (scores == np.floor(scores)).all():
            # merge ranks, not logarithms of probabilities: Zipf's law over the order of the pieces
            scores = -np.log(np.argsort(np.argsort(self.ids)) + 2.0)
        self.scores = scores
        self.size = size

    def __len__(self) -> int:
        return len(self.ids)

    def hits(self, values: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """For each length the number of the piece that begins at a place, or -1.

        ``ends`` holds for every place where its word ends.
        """
        sub, found = arrays.Substrings(values), []
        for length in range(1, self.longest + 1):
            result = np.full(len(values), -1, np.int32)
            places = np.flatnonzero(np.arange(len(values)) + length <= ends)
            keys = sub.hashes(places, places + length)
            likely = self.leading[keys >> np.uint64(44)]
            places, keys = places[likely], keys[likely]
            rows = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            same = self.keys[rows] == keys
            places, rows = places[same], rows[same]
            exact = (values[places[:, None] + np.arange(length)] == self.points[rows, :length]).all(axis=1)
            if length < self.longest:
                exact &= self.points[rows, length] == 0
            result[places[exact]] = rows[exact]
            found.append(result)
        return found


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """Segments of the given words, by length, with the pieces that begin at each letter."""

    def __init__(self, vocabulary: Pieces, values: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        # words lie one after another and fill ``values``
        self.values = values
        self.hits = vocabulary.hits(values, np.repeat(ends, ends - starts))
        crossed = np.zeros(len(values) + 1, np.int64)
        for length, found in enumerate(self.hits, 1):
            if length > 1:
                places = np.flatnonzero(found >= 0)
                np.add.at(crossed, places + 1, 1)
                np.add.at(crossed, places + length, -1)
        free = np.cumsum(crossed)[:-1] == 0
        free[starts] = True
        self.starts = np.flatnonzero(free)
        self.ends = np.append(self.starts[1:], len(values))
        self.word = np.searchsorted(starts, self.starts, "right") - 1

    def by_length(self):
        """(numbers of the segments, their length, their starts), a length at a time."""
        lengths = self.ends - self.starts
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order], prepend=-1))
        for group in np.split(order, edges[1:]) if len(order) else []:
            yield group, int(lengths[group[0]]), self.starts[group]
