"""Ids of texts by way of their distinct words: each word of an Arrow batch is encoded once."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_WORDS = 150_000


class WordCodes:
    """Ids of words, of which a bounded number is kept between batches; ``encode_words`` gives those of new ones."""

    def __init__(self, encode_words: Callable[[list[str]], list[list[int]]], most: int = CACHE_WORDS) -> None:
        self.encode_words, self.most = encode_words, most
        self.known: dict[str, bytes] = {}

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words in a row, and where each word's ids start."""
        known = self.known
        new = [w for w in words if w not in known]
        ids = self.encode_words(new) if new else []
        if len(known) + len(new) > self.most:  # only what this batch needs stays
            known = self.known = {w: known[w] for w in words if w in known}
        known.update((w, array("I", i).tobytes()) for w, i in zip(new, ids, strict=True))
        cut = [known[w] for w in words]
        lengths = np.fromiter(map(len, cut), np.int64, len(cut)) // 4
        return np.frombuffer(b"".join(cut), np.uint32), np.concatenate([[0], np.cumsum(lengths)])

    def expand(self, owner: np.ndarray, words: pa.Array, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each text's ids start (one more than there are texts).

        ``owner`` is the text number of each word, ascending.
        """
        coded = pc.dictionary_encode(words)
        flat, starts = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        number = np.asarray(coded.indices)
        lengths = starts[number + 1] - starts[number]
        before = np.cumsum(lengths) - lengths
        ids = flat[np.repeat(starts[number] - before, lengths) + np.arange(int(lengths.sum()))]
        per_text = np.bincount(owner, weights=lengths, minlength=texts).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_text)])


def slices(texts: pa.Array, most_bytes: int = 3 << 20) -> Iterator[tuple[int, int]]:
    """Start and number of texts of parts that hold about ``most_bytes``, or one text."""
    start, held = 0, 0
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for i, n in enumerate(sizes):
        if i > start and held + n > most_bytes:
            yield start, i - start
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes) - start
    pa.default_memory_pool().release_unused()
