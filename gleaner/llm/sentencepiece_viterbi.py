"""SentencePiece encoding and decoding by a batched Viterbi search.

Text is cut where no piece of the vocabulary can reach across: before a space
and around characters that stand in no longer piece. Equal-length words advance
together: hashes of their substrings probe the sorted piece keys, and maxima
over the possible last pieces store backpointers. The segmentation is the one
with the highest sum of piece scores, ties going to the longest last piece; a
character without a piece is encoded by its UTF-8 bytes.

The vocabulary file holds scores by merge rank. The search maximises their sum,
which is what SentencePiece does for a unigram model of the same pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .language_id import vocabulary_path
from . import pieces
from .pieces import PieceTable, by_length, code_points, last_pieces, prefix_hashes, read_pieces
from .word_codes import WordCodes, slices

SPACE = "▁"
#: What a character without a piece scores below the worst piece.
PENALTY = 10.0


class Vocabulary:
    def __init__(self, path: str) -> None:
        names, scores, plain = read_pieces(path)
        own = {p: i for i, (p, ok) in enumerate(zip(names, plain, strict=True)) if ok}
        self.table = PieceTable(own)
        self.scores = np.array(scores)
        self.unknown = min(scores[i] for i in own.values()) - PENALTY
        #: By piece, then for a letter without a piece and for no piece at all.
        self.gains = np.concatenate([self.scores, [self.unknown, -np.inf]])
        self.byte_ids = [names.index(f"<0x{b:02X}>") for b in range(256)]
        joined = sorted({c for p in own if len(p) > 1 for c in p} - {SPACE})
        letters = "".join(map(re.escape, joined))
        self.units = re.compile(f"{SPACE}*[{letters}]+|{SPACE}+|.", re.S) if joined else re.compile(".", re.S)
        if any(SPACE in p.lstrip(SPACE) for p in own):
            raise ValueError("a piece holds a space after another character")
        self.spell = [p.replace(SPACE, " ").encode() if ok else b"" for p, ok in zip(names, plain, strict=True)]
        for b, i in enumerate(self.byte_ids):
            self.spell[i] = bytes([b])

    def viterbi(self, words: list[str]) -> list[list[int]]:
        """Ids of words of one length. Positions come in blocks, so a run without an end needs memory for its backpointers only."""
        n, count, longest = len(words[0]), len(words), self.table.longest
        hashes = prefix_hashes(code_points(words, n))
        length = np.zeros((count, n + 1), np.int16)
        piece = np.full((count, n + 1), -1, np.int32)
        rows = np.arange(count)
        carried = np.full((count, longest), -np.inf)
        carried[:, -1] = 0.0
        for start in range(0, n, pieces.BLOCK):
            ids = last_pieces(hashes, self.table, len(self.scores), start, min(n, start + pieces.BLOCK))
            gain = self.gains[ids]
            best = np.full((count, longest + ids.shape[1]), -np.inf)
            best[:, :longest] = carried
            for j in range(ids.shape[1]):
                sums = best[:, j : j + longest] + gain[:, j]
                k = sums.argmax(axis=1)  # the first of equal ones is the longest
                best[:, longest + j] = sums[rows, k]
                length[:, start + j + 1] = longest - k
                piece[:, start + j + 1] = ids[rows, j, k]
            carried = best[:, -longest:] - best[:, -1:]
        piece[piece >= len(self.scores)] = -1
        at = np.full(count, n)
        back: list[list[int]] = [[] for _ in words]
        while (at > 0).any():
            going = rows[at > 0]
            for r, i, end in zip(going.tolist(), piece[going, at[going]].tolist(), at[going].tolist(), strict=True):
                if i >= 0:
                    back[r].append(i)
                else:
                    spelled = words[r][end - 1].encode("utf-8", "surrogatepass")
                    back[r].extend(self.byte_ids[b] for b in reversed(spelled))
            at[going] -= length[going, at[going]]
        return [ids[::-1] for ids in back]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words, each of which has a space before it that is not part of it."""
        units: dict[str, int] = {}
        parts = [[units.setdefault(u, len(units)) for u in self.units.findall(SPACE + w)] for w in words]
        distinct = list(units)
        found: list[list[int]] = [[]] * len(distinct)
        for _, members in by_length(distinct, 1 << 17):
            for i, ids in zip(members, self.viterbi([distinct[i] for i in members]), strict=True):
                found[i] = ids
        return [[i for u in p for i in found[u]] for p in parts]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space before the first word is dropped."""
        text = b"".join(map(self.spell.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Text number and word, for words that begin with a space; further spaces before a word are part of it as ``▁``."""
    texts = pc.fill_null(texts, "")
    plain = pc.split_pattern(texts, " ")
    runs = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE)), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
    runs = pc.or_(runs, pc.equal(texts, ""))
    if pc.any(runs).as_py():
        lists = plain.to_pylist()
        for i in np.nonzero(np.asarray(runs.to_numpy(zero_copy_only=False)))[0].tolist():
            text = texts[i].as_py()
            found = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", SPACE + text.replace(" ", SPACE)) if text else []
            lists[i] = [w[1:] for w in found]
        plain = pa.array(lists, pa.list_(pa.string()))
    return np.asarray(pc.list_parent_indices(plain)), pc.list_flatten(plain)


_vocabularies: dict[str, tuple[Vocabulary, WordCodes]] = {}


def vocabulary(path: str) -> tuple[Vocabulary, WordCodes]:
    if path not in _vocabularies:
        v = Vocabulary(path)
        _vocabularies[path] = (v, WordCodes(v.encode_words))
    return _vocabularies[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) for rows of (doc_id, text).

    Null and empty texts have no ids. Repeated rows give repeated results, an empty table an empty one. Very long
    texts and runs without a space are encoded whole. Of segmentations with equal scores the one with the longest
    last piece is taken, piece by piece from the end. Further columns, whatever their names, are not read.
    """
    path = path or vocabulary_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, codes = vocabulary(path)
        for batch in batches:
            for at, n in slices(batch.column("text"), 6 << 20):
                part = batch.slice(at, n)
                ids, starts = codes.expand(*split_words(part.column("text")), n)
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) for rows of (doc_id, ids); null ids give a null text."""
    path = path or vocabulary_path()
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, _ = vocabulary(path)
        for batch in batches:
            texts = [None if i is None else v.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip): what encoding gives, and whether decoding gives the text back.

    ``▁`` itself decodes to a space, so a text that holds it does not come back; nor does a null one.
    """
    path = path or vocabulary_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, codes = vocabulary(path)
        for batch in batches:
            for at, n in slices(batch.column("text"), 6 << 20):
                part = batch.slice(at, n)
                ids, starts = codes.expand(*split_words(part.column("text")), n)
                texts = part.column("text").to_pylist()
                cuts = [ids[starts[i] : starts[i + 1]] for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(c) for c in cuts], pa.int64()),
                        pa.array([zlib.crc32(c.astype("<u4").tobytes()) for c in cuts], pa.int64()),
                        pa.array([v.decode(c.tolist()) == t for c, t in zip(cuts, texts, strict=True)], pa.bool_()),
                    ],
                    ["doc_id", "n_tokens", "ids_crc32", "round_trip"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_crc32 long, round_trip boolean"
    )


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and checksum of every document's ids, and whether they decode to its text; one row for each row."""
    return digest(table(spark, sf_dir, "documents"))
