"""Alignment of two tokenizers by byte-owner arrays, and how often their tokens meet in a corpus.

Neither tokenizer joins the end of a word to the space that follows it, so a text
is encoded by its words, each distinct one of a block once. In a block the index of
every token is repeated over its bytes, once for either tokenizer. Where the pair
of owners changes, two tokens begin to overlap; where both owners change at once,
both tokenizers cut, and a new group begins. A block is some megabytes of texts,
or one text.

The statistics of the corpus are Spark's: linked pairs of ids are counted by block
and summed by a shuffle, a pair's count goes back to the blocks that hold the
pair, and each block looks its documents' links up.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.storage import materialize

from .common import table
from .packing import BYTE_SIGNS
from .word_codes import slices

#: Bytes of the texts of a block, unless one text has more.
BLOCK_BYTES = 2 << 20
#: Words that are encoded as one line.
LINE_WORDS = 4096
#: A pair of ids is one number: A's id in the upper bits.
ID_BITS = 32
#: Groups of more links than this are counted by distinct ids, one group at a time.
WIDE = 4096
SPACE = "▁"
_WORD_END = re.compile(r"(?<=\S) ")


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for each i, ``lengths[i]`` of them."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Coder:
    """A tokenizer: ids of words that a space precedes, and the bytes of every id.

    ``encode`` gives the ids of texts, each with a space before it.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], spelled: list[bytes]) -> None:
        self.encode = encode
        self.lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.joined = np.frombuffer(b"".join(spelled), np.uint8)

    def octets(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids in a row."""
        return self.joined[_ranges(self.starts[ids], self.lengths[ids])]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and where each word's ids start (one more than there are words).

        Words are encoded many at a time, in lines: a line's ids are cut where a word's bytes end. Words that end with
        white space, which a tokenizer may join to the next space, and those of lines that it does not spell stand alone.
        """
        ends_well = [bool(w) and not w[-1].isspace() for w in words]
        order = [i for i, good in enumerate(ends_well) if good]
        found: list[tuple[list[int], np.ndarray, np.ndarray]] = []
        alone = [i for i, good in enumerate(ends_well) if not good]
        lines = [order[at : at + LINE_WORDS] for at in range(0, len(order), LINE_WORDS)]
        for line, ids in zip(lines, self.encode([" ".join([words[i] for i in line]) for line in lines]), strict=True):
            ids = np.array(ids, np.int32)
            wanted = np.cumsum([len(words[i].encode()) + 1 for i in line])
            ends = np.cumsum(self.lengths[ids])
            at = np.searchsorted(ends, wanted)
            if len(ends) and ends[-1] == wanted[-1] and np.array_equal(ends[at], wanted):
                found.append((line, ids, np.diff(at + 1, prepend=0)))
            else:
                alone += line
        own = [np.array(x, np.int32) for x in self.encode([words[i] for i in alone])]
        if alone:
            found.append((alone, np.concatenate(own), np.array([len(x) for x in own])))
        sizes = np.zeros(len(words), np.int64)
        for line, _, n in found:
            sizes[line] = n
        starts = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(starts[-1], np.int32)
        for line, ids, n in found:
            out[_ranges(starts[line], n)] = ids
        return out, starts


def byte_level(path: str) -> Coder:
    """The byte-level tokenizer in ``path``; strings of special tokens are plain text."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    signs = {chr(sign): byte for byte, sign in BYTE_SIGNS.items()}
    spelled = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        spelled[i] = bytes(signs.get(c, ord(c) & 255) for c in token)

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    return Coder(encode, spelled)


def piece_level(path: str) -> Coder:
    """The piece tokenizer in ``path``, which puts a space before what it encodes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            spelled.append(bytes([int(piece[3:-1], 16)]))
        else:
            spelled.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(SPACE, " ").encode())
        if re.search(f"[^{SPACE}]{SPACE}", piece):
            raise ValueError(f"piece {piece!r} joins words")
    space = model.piece_to_id(SPACE)

    def encode(texts: list[str]) -> list[list[int]]:
        return [i if t else [space] for t, i in zip(texts, model.encode(texts, num_threads=1), strict=True)] if texts else []

    return Coder(encode, spelled)


_coders: dict[tuple[str, str], tuple[Coder, Coder]] = {}


def coders(path_a: str, path_b: str) -> tuple[Coder, Coder]:
    if (path_a, path_b) not in _coders:
        _coders[path_a, path_b] = byte_level(path_a), piece_level(path_b)
    return _coders[path_a, path_b]


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Text number and word, without the space before it; null and empty texts have none.

    A space ends a word only if no white space stands before it: the byte-level tokenizer divides longer runs.
    """
    texts = pc.fill_null(texts, "")
    odd = pc.or_(pc.match_substring_regex(texts, r"[\s\x0b\x1c-\x1f\x85\p{Z}] "), pc.or_(pc.starts_with(texts, " "), pc.equal(texts, "")))
    plain = pc.split_pattern(texts, " ")
    if pc.any(odd).as_py():
        lists = plain.to_pylist()
        for i in np.nonzero(np.asarray(odd.to_numpy(zero_copy_only=False)))[0].tolist():
            text = texts[i].as_py()
            lists[i] = _WORD_END.split(text) if text else []
        plain = pa.array(lists, pa.list_(pa.string()))
    return np.asarray(pc.list_parent_indices(plain)), pc.list_flatten(plain)


class Aligned:
    """Groups, overlaps and links of words, from the ids that two coders give them.

    ``ok[w]`` tells whether both spell word w; others have nothing. A coder that does not spell a word loses
    bytes of it and adds none, so a text is spelled if all its words are.
    """

    def __init__(self, words: list[str], a: Coder, b: Coder) -> None:
        n = len(words)
        ids_a, from_a = a.words(words)
        ids_b, from_b = b.words(words)
        wanted = [(" " + w).encode() for w in words]
        self.ok = self._spelled(a, ids_a, from_a, wanted) & self._spelled(b, ids_b, from_b, wanted)
        word_a, word_b = (np.repeat(np.arange(n), np.diff(x)) for x in (from_a, from_b))
        keep_a, keep_b = self.ok[word_a], self.ok[word_b]
        self.a, self.b, word_a, word_b = ids_a[keep_a].astype(np.int64), ids_b[keep_b].astype(np.int64), word_a[keep_a], word_b[keep_b]
        owner_a = np.repeat(np.arange(len(self.a), dtype=np.int32), a.lengths[self.a])
        owner_b = np.repeat(np.arange(len(self.b), dtype=np.int32), b.lengths[self.b])
        moved_a, moved_b = (np.diff(x, prepend=-1) > 0 for x in (owner_a, owner_b))
        overlap, cut = moved_a | moved_b, moved_a & moved_b
        group = np.cumsum(cut) - 1
        self.groups = int(group[-1]) + 1 if len(group) else 0
        group_a, group_b = group[moved_a], group[moved_b]  # a token is of its first byte's group
        self.size_a, self.size_b = (np.bincount(x, minlength=self.groups) for x in (group_a, group_b))
        self.first_a, self.first_b = (np.cumsum(x) - x for x in (self.size_a, self.size_b))
        self.word = word_a[self.first_a]  # of each group
        per_word = lambda x, weights=None: np.bincount(x, weights, minlength=n).astype(np.int64)
        self.n_a, self.n_b, self.n_groups = per_word(word_a), per_word(word_b), per_word(self.word)
        self.n_overlaps = per_word(word_a[owner_a[overlap]])
        self.n_links = per_word(self.word, self.size_a * self.size_b)

    @staticmethod
    def _spelled(coder: Coder, ids: np.ndarray, starts: np.ndarray, wanted: list[bytes]) -> np.ndarray:
        got = coder.octets(ids).tobytes()
        ends = np.concatenate([[0], np.cumsum(coder.lengths[ids])])[starts].tolist()
        if got == b"".join(wanted) and np.array_equal(np.diff(ends), np.fromiter(map(len, wanted), np.int64, len(wanted))):
            return np.ones(len(wanted), bool)
        return np.array([got[x:y] == w for x, y, w in zip(ends, ends[1:], wanted, strict=False)], bool)

    def spelling(self) -> pa.Array:
        """For each word its groups as ``a1,a2|b1;a3|b2,b3``."""
        sides = []
        for ids, first in ((self.a, self.first_a), (self.b, self.first_b)):
            offsets = pa.array(np.append(first, len(ids)), pa.int32())
            sides.append(pc.binary_join(pa.ListArray.from_arrays(offsets, pc.cast(pa.array(ids), pa.string())), ","))
        said = pc.binary_join_element_wise(*sides, "|")
        return _joined(said, self.n_groups)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, pair, times), by word: the linked pairs of ids and how many links of the word have them; pairs may repeat."""
        wide = self.size_a * self.size_b > WIDE
        na, nb = (np.where(wide, 0, x) for x in (self.size_a, self.size_b))
        n = na * nb
        place = _ranges(np.zeros_like(n), n)
        across = np.repeat(nb, n)
        left = self.a[np.repeat(self.first_a, n) + place // np.maximum(across, 1)]
        right = self.b[np.repeat(self.first_b, n) + place % np.maximum(across, 1)]
        out = [(np.repeat(self.word, n), left << ID_BITS | right, np.ones(len(left), np.int64))]
        for g in np.nonzero(wide)[0].tolist():
            i, x = np.unique(self.a[self.first_a[g] : self.first_a[g] + self.size_a[g]], return_counts=True)
            j, y = np.unique(self.b[self.first_b[g] : self.first_b[g] + self.size_b[g]], return_counts=True)
            out.append((np.full(len(i) * len(j), self.word[g]), (i[:, None] << ID_BITS | j).ravel(), np.outer(x, y).ravel()))
        word, pair, times = (np.concatenate(c) for c in zip(*out, strict=True))
        order = np.argsort(word, kind="stable") if len(out) > 1 else slice(None)
        return word[order], pair[order], times[order]


def _joined(parts: pa.Array, counts: np.ndarray) -> pa.Array:
    """Runs of ``counts[i]`` parts, joined by semicolons."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, parts), ";")


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of their times."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times[order], first) if len(keys) else times


_COUNTS = ("n_a", "n_b", "n_groups", "n_overlaps", "n_links")


def _align_block(texts: pa.Array, a: Coder, b: Coder) -> list[pa.Array]:
    """The counts of each text, its groups, its distinct pairs and how many links have them."""
    n = len(texts)
    owner, words = split_words(texts)
    coded = pc.dictionary_encode(words)
    number = np.asarray(coded.indices).astype(np.int64)
    aligned = Aligned(coded.dictionary.to_pylist(), a, b)
    bad = np.bincount(owner, weights=~aligned.ok[number], minlength=n) > 0
    owner, number = owner[~bad[owner]], number[~bad[owner]]
    counts = [np.bincount(owner, getattr(aligned, c)[number], minlength=n).astype(np.int64) for c in _COUNTS]
    groups = _joined(aligned.spelling().take(pa.array(number)), np.bincount(owner, minlength=n))
    word, pair, times = aligned.links()
    distinct, local = np.unique(pair, return_inverse=True)
    held = np.bincount(word, minlength=len(coded.dictionary))
    at = _ranges((np.cumsum(held) - held)[number], held[number])
    keys, sums = _summed(np.repeat(owner, held[number]) * max(1, len(distinct)) + local[at], times[at])
    text, which = np.divmod(keys, max(1, len(distinct)))
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (distinct[which], sums)]
    return [*(pa.array(c, pa.int64()) for c in counts), groups, *lists]


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of (doc_id, text) aligned: (block, doc_id, n_a, n_b, n_groups, n_overlaps, n_links, groups, pairs, times).

    ``groups`` are the ids between common cuts, as ``a1,a2|b1;a3|b2,b3``. ``pairs`` are the distinct linked pairs of ids,
    A's in the upper 32 bits, and ``times`` how many links of the text have them; tokens are linked if they share
    a group. ``block`` numbers the texts that were aligned together. Null and empty texts, and those that a tokenizer does
    not spell byte by byte (``▁`` becomes a space), have no tokens. Very long texts are aligned whole. Repeated rows give
    repeated results, an empty table an empty one. Further columns, whatever their names, are not read.
    """
    path_a, path_b = path_a or paths()[0], path_b or paths()[1]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coders(path_a, path_b)
        block = TaskContext.get().partitionId() << ID_BITS
        for batch in batches:
            for at, n in slices(batch.column("text"), block_bytes):
                part = batch.slice(at, n)
                columns = [pa.array(np.full(n, block), pa.int64()), part.column("doc_id"), *_align_block(part.column("text"), a, b)]
                yield pa.RecordBatch.from_arrays(columns, ["block", "doc_id", *_COUNTS, "groups", "pairs", "times"])
                block += 1

    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return docs.select("doc_id", "text").mapInArrow(run, f"block long, doc_id {kind}, {counts}, groups string, pairs array<long>, times array<long>")


def pair_counts(held: DataFrame) -> DataFrame:
    """(pair, held, best) from (block, pair, n): how many texts hold a pair linked, and whether no pair of its A id is held by more."""
    counts = materialize(held.groupBy("pair").agg(F.sum("n").alias("held")), "pair-counts")
    a = F.shiftright("pair", ID_BITS)
    most = counts.groupBy(a.alias("a")).agg(F.max("held").alias("most"))
    return counts.join(most, a == F.col("a")).select("pair", "held", (F.col("held") == F.col("most")).alias("best"))


def _look_up(key: tuple, rows: pa.Table, known: pa.Table) -> pa.Table:
    """The rows of a block with n_best and count_sum, from the counts of its pairs."""
    rows, known = rows.combine_chunks(), known.combine_chunks()
    pair = known.column("pair").to_numpy()
    order = np.argsort(pair)
    held, best = (known.column(c).to_numpy()[order] for c in ("held", "best"))
    pairs, times = (rows.column(c).combine_chunks() for c in ("pairs", "times"))
    at = np.searchsorted(pair[order], pairs.flatten().to_numpy())
    text = np.repeat(np.arange(rows.num_rows), np.asarray(pc.list_value_length(pairs)))
    links = times.flatten().to_numpy()
    total = lambda x: pa.array(np.bincount(text, x, minlength=rows.num_rows).astype(np.int64), pa.int64())
    out = rows.drop_columns(["block", "pairs", "times"])
    return out.append_column("n_best", total(links * best[at])).append_column("count_sum", total(links * held[at]))


def align_corpus(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``align`` of all rows, ``groups`` as their SHA-256 (empty without tokens), with ``n_best`` and ``count_sum``.

    ``n_best`` are the links whose pair is held linked by as many texts as any pair of the same A id, ties included;
    ``count_sum`` is the sum over links of the number of texts that hold the pair.
    """
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    aligned = materialize(align(docs, path_a, path_b, block_bytes).withColumn("groups", digest), "aligned")
    held = materialize(
        aligned.select("block", F.explode("pairs").alias("pair")).groupBy("block", "pair").agg(F.count(F.lit(1)).alias("n")), "pairs-of-blocks"
    )
    known = held.select("block", "pair").join(pair_counts(held), "pair")
    kind = aligned.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    met = aligned.groupBy("block").cogroup(known.groupBy("block"))
    return met.applyInArrow(_look_up, f"doc_id {kind}, {counts}, groups string, n_best long, count_sum long")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document under both tokenizers, one row for each row; see ``align`` for odd rows."""
    return align_corpus(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"), "n_overlaps"
    )
