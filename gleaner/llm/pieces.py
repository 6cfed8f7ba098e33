"""Lookup of vocabulary pieces in batches of equal-length words.

A word is a row of code points. The polynomial hash of every substring comes
from prefix hashes, and a sorted array of piece hashes for each piece length
tells which substrings are pieces. Pieces come from a public SentencePiece file,
which is read and never trained.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Positions of a word whose pieces are looked up at once.
BLOCK = 1 << 16
#: Each code point is spread over 64 bits before it enters the polynomial.
MIX = np.uint64(0xD6E8FEB86659FD93)


def _spread(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * MIX
    x ^= x >> np.uint64(32)
    return x * MIX


def code_points(words: list[str], length: int) -> np.ndarray:
    joined = "".join(words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32).reshape(len(words), length)


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """(words, length + 1): hash of each prefix, modulo 2**64."""
    spread = _spread(codes)
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * BASE + spread[:, j]
    return out


def by_length(words: list[str], most_cells: int = 1 << 20) -> Iterator[tuple[int, list[int]]]:
    """Word numbers grouped by length, in groups of bounded size."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, members in groups.items():
        step = max(1, most_cells // max(n, 1))
        for at in range(0, len(members), step):
            yield n, members[at : at + step]


class PieceTable:
    """Sorted keys of pieces by length; ``find_all`` gives piece ids or -1."""

    def __init__(self, pieces: dict[str, int]) -> None:
        self.longest = max(map(len, pieces), default=1)
        self.keys: dict[int, np.ndarray] = {}
        self.ids: dict[int, np.ndarray] = {}
        for n in range(1, self.longest + 1):
            own = [p for p in pieces if len(p) == n]
            if not own:
                continue
            hashes = prefix_hashes(code_points(own, n))[:, n]
            order = np.argsort(hashes)
            self.keys[n] = hashes[order]
            if (self.keys[n][1:] == self.keys[n][:-1]).any():
                raise ValueError("two pieces share a hash")
            self.ids[n] = np.array([pieces[p] for p in own], np.int64)[order]
        self.power = [np.uint64(1)]
        with np.errstate(over="ignore"):
            for _ in range(self.longest):
                self.power.append(np.uint64(self.power[-1] * BASE))

    def find_all(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """(words, places): ids of the pieces of length n that begin at each place of every word; -1 for none."""
        return self._look_up(hashes[:, n:] - hashes[:, :-n] * self.power[n], n)

    def _look_up(self, wanted: np.ndarray, n: int) -> np.ndarray:
        keys = self.keys[n]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, self.ids[n][at], -1)


def last_pieces(hashes: np.ndarray, tab: PieceTable, size: int, start: int, stop: int) -> np.ndarray:
    """(words, stop - start, longest): the piece that ends at each position after start up to stop, longest first.

    ``size`` stands for a letter without a piece, ``size + 1`` for no piece of that length.
    """
    longest = tab.longest
    out = np.full((hashes.shape[0], stop - start, longest), size + 1, np.int32)
    out[:, :, longest - 1] = size
    for n in tab.keys:
        first = max(start, n - 1)  # of the positions, each of which is an end less one
        if first >= stop:
            continue
        ids = tab.find_all(hashes[:, first + 1 - n : stop + 1], n)
        known = ids >= 0
        out[:, first - start :, longest - n][known] = ids[known]
    return out


def read_pieces(path: str) -> tuple[list[str], list[float], list[bool]]:
    """Pieces, scores and whether each is an ordinary piece, in order of id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in ids]
    return [model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], plain
