"""Language ID by unigram pieces, summed over all segmentations of each word.

The pieces are those of a fixed public vocabulary. For each language every piece
has a probability, learned by expectation-maximisation from labelled texts: at
most about ``DOCS_PER_LANGUAGE`` documents of a language, taken by hash of
doc_id. A word's likelihood is the sum over all its segmentations, by the forward
algorithm; a text's is the product over its words. Words of one length advance
together, and each distinct word of an Arrow batch is scored once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.storage import materialize

from .common import table
from . import pieces
from .pieces import PieceTable, by_length, code_points, last_pieces, prefix_hashes, read_pieces
from .word_codes import slices

DOCS_PER_LANGUAGE = 1000
ROUNDS = 3
MARK = "▁"
#: Columns of the forward sums between two scalings.
SCALE_EVERY = 16
#: Probability of a letter that no piece covers.
FLOOR = 1e-7
#: So many distinct words are remembered by a task, none longer than so many letters.
CACHE_WORDS, CACHE_LETTERS = 50_000, 64


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Model:
    path: str
    langs: list[str]
    #: (pieces, languages)
    probs: np.ndarray


_tables: dict[str, tuple[PieceTable, int]] = {}
_cache: dict[int, tuple[Model, dict[str, np.ndarray]]] = {}


def piece_table(path: str) -> tuple[PieceTable, int]:
    """The lower-cased letter pieces of a vocabulary, by new ids in order of rank; and their number."""
    if path not in _tables:
        names, _, plain = read_pieces(path)
        own: dict[str, int] = {}
        for p, ok in zip(names, plain, strict=True):
            if ok and p.lstrip(MARK).isalpha() and p.count(MARK) <= 1 and p == p.lower():
                own.setdefault(p, len(own))
        _tables[path] = (PieceTable(own), len(own))
    return _tables[path]


def _parts_of(batches: Iterator[pa.RecordBatch], at: int | str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold a bounded number of bytes."""
    for batch in batches:
        for start, n in slices(batch.column(at)):
            yield batch.slice(start, n)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Text number and word number of each run of letters, and the distinct words (marked, lower case)."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    runs = pc.split_pattern_regex(lower, r"\PL+")
    owner = np.asarray(pc.list_parent_indices(runs))
    coded = pc.dictionary_encode(pc.list_flatten(runs))
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    codes, words = np.asarray(coded.indices), coded.dictionary.to_pylist()
    if "" in words:
        there = codes != words.index("")
        owner, codes = owner[there], codes[there]
    return owner, codes, words


def _with_floor(probs: np.ndarray) -> np.ndarray:
    return np.vstack([probs, np.full((1, probs.shape[1]), FLOOR), np.zeros((1, probs.shape[1]))])


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Log-likelihood of each word in each language: all segmentations summed, words of any length whole.

    Sums are scaled every ``SCALE_EVERY`` columns, so nothing underflows.
    """
    tab, size = piece_table(model.path)
    probs, longest = _with_floor(model.probs), tab.longest
    out = np.zeros((len(words), len(model.langs)))
    marked = [MARK + w for w in words]
    for n, members in by_length(marked, 1 << 16):
        hashes = prefix_hashes(code_points([marked[i] for i in members], n))
        scale = np.zeros((len(members), probs.shape[1]))
        carried = np.zeros((len(members), longest, probs.shape[1]))
        carried[:, -1] = 1.0
        for start in range(0, n, pieces.BLOCK):
            ids = last_pieces(hashes, tab, size, start, min(n, start + pieces.BLOCK))
            # column j holds the sum over the segmentations of the first start + j + 1 - longest letters
            sums = np.zeros((len(members), longest + ids.shape[1], probs.shape[1]))
            sums[:, :longest] = carried
            for j in range(ids.shape[1]):
                sums[:, longest + j] = (sums[:, j : j + longest] * probs[ids[:, j]]).sum(axis=1)
                if j % SCALE_EVERY == SCALE_EVERY - 1:
                    by = sums[:, longest + j].copy()
                    sums[:, j + 1 : j + 1 + longest] /= by[:, None]
                    scale += np.log(by)
            carried = sums[:, -longest:]
        out[members] = scale + np.log(carried[:, -1])
    return out


def expected_counts(words: list[str], weights: np.ndarray, path: str, probs: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, (pieces, languages); ``weights`` is (words, languages)."""
    tab, size = piece_table(path)
    wide, longest, langs = _with_floor(probs), tab.longest, probs.shape[1]
    out = np.zeros((size, langs))
    marked = [MARK + w for w in words]
    for n, members in by_length(marked, 1 << 15):
        count = len(members)
        hashes = prefix_hashes(code_points([marked[i] for i in members], n))
        ids = last_pieces(hashes, tab, size, 0, n)
        # sums before and after each place, each with the log of its scale; place k is column k + longest - 1 and k
        before, after = np.zeros((count, longest + n, langs)), np.zeros((count, n + longest, langs))
        before_log, after_log = np.zeros_like(before), np.zeros_like(after)
        before[:, longest - 1], after[:, n] = 1.0, 1.0
        for k in range(1, n + 1):
            before[:, k + longest - 1] = (before[:, k - 1 : k + longest - 1] * wide[ids[:, k - 1]]).sum(axis=1)
            if k % SCALE_EVERY == 0:
                by = before[:, k + longest - 1].copy()
                before[:, k : k + longest] /= by[:, None]
                before_log[:, k:] += np.log(by)[:, None]
        steps = np.arange(longest)
        for k in range(n - 1, -1, -1):
            reach = min(longest, n - k)
            p = wide[ids[:, k + steps[:reach], longest - 1 - steps[:reach]]]
            after[:, k] = (after[:, k + 1 : k + 1 + reach] * p).sum(axis=1)
            if (n - k) % SCALE_EVERY == 0:
                by = after[:, k].copy()
                after[:, k : k + longest] /= by[:, None]
                after_log[:, : k + longest] += np.log(by)[:, None]
        total = before_log[:, -1] + np.log(before[:, -1])
        share = weights[members]
        for k in range(1, n + 1):
            word, back = np.nonzero(ids[:, k - 1] < size)
            if not len(word):
                continue
            piece, from_ = ids[word, k - 1, back], k - 1 + back
            logs = before_log[word, from_] + after_log[word, k] - total[word]
            flow = before[word, from_] * probs[piece] * after[word, k] * np.exp(logs) * share[word]
            np.add.at(out, piece, flow)
    return out


def fit(docs: DataFrame, usable: Column, path: str | None = None, per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Learn from the rows where ``usable`` holds and lang is not null; none give a model without languages.

    The sample is bounded by ``per_language`` (expected documents of a language),
    the same at every size of ``docs``; what comes to the driver is a number for
    each piece and language.
    """
    path = path or vocabulary_path()
    known = docs.select("doc_id", "text", "lang").where(usable & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a number for each language
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(per_language / n)).otherwise(share)
    sample = known.where(place < share).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts_of(batches):
            owner, codes, words = _words(batch.column("text"))
            lang = pc.dictionary_encode(batch.column("lang"))
            pair = np.asarray(lang.indices)[owner].astype(np.int64) * max(1, len(words)) + codes
            each, n = np.unique(pair, return_counts=True)
            names = lang.dictionary.to_pylist()
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([names[k // len(words)] for k in each], pa.string()),
                    "word": pa.array([words[k % len(words)] for k in each], pa.string()),
                    "n": pa.array(n, pa.int64()),
                }
            )

    words = materialize(
        sample.mapInArrow(count, "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")),
        "words",
    )
    langs = sorted(counts)
    _, size = piece_table(path)
    rank = 1.0 / (np.arange(size) + 100.0)
    probs = np.repeat((rank / rank.sum())[:, None], max(1, len(langs)), axis=1)
    for _ in range(ROUNDS if langs else 0):

        def expect(batches: Iterator[pa.RecordBatch], probs: np.ndarray = probs) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size, len(langs)))
            for batch in batches:
                coded = pc.dictionary_encode(batch.column("word"))
                weights = np.zeros((len(coded.dictionary), len(langs)))
                at = pc.index_in(batch.column("lang"), pa.array(langs, pa.string()))
                np.add.at(weights, (np.asarray(coded.indices), np.asarray(at)), np.asarray(batch.column("n")))
                total += expected_counts(coded.dictionary.to_pylist(), weights, path, probs)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_pydict(
                {"piece": pa.array(piece, pa.int64()), "lang": pa.array(lang, pa.int64()), "n": pa.array(total[piece, lang])}
            )

        got = words.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        rows = got.toPandas()
        uses = np.full((size, len(langs)), 0.01)
        uses[rows["piece"].to_numpy(int), rows["lang"].to_numpy(int)] += rows["n"].to_numpy(float)
        probs = uses / uses.sum(axis=0)
    return Model(path, langs, probs)


def classify(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """Language and its share of the likelihood for every text; ``und`` and 0 without a letter."""
    owner, codes, words = _words(texts)
    if not model.langs or not len(codes):
        return ["und"] * len(texts), np.zeros(len(texts))
    if id(model) not in _cache:
        _cache.clear()
        _cache[id(model)] = (model, {})
    known = _cache[id(model)][1]
    new = [w for w in words if w not in known]
    table_ = np.zeros((len(words), len(model.langs)))
    fresh = dict(zip(new, word_scores(new, model), strict=True)) if new else {}
    for i, w in enumerate(words):
        table_[i] = known[w] if w in known else fresh[w]
    for w in new:
        if len(known) >= CACHE_WORDS:
            break
        if len(w) <= CACHE_LETTERS:
            known[w] = fresh[w]
    totals = np.stack(
        [np.bincount(owner, weights=table_[codes, k], minlength=len(texts)) for k in range(len(model.langs))], axis=1
    )
    shares = np.exp(totals - totals.max(axis=1, keepdims=True))
    shares /= shares.sum(axis=1, keepdims=True)
    best = shares.argmax(axis=1)
    some = np.bincount(owner, minlength=len(texts)) > 0
    pred = [model.langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
    return pred, np.where(some, shares[np.arange(len(best)), best], 0.0)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row; lang, source and doc_id are not looked at.

    Null texts and texts without a letter are ``und`` with score 0. Equal
    likelihoods go to the language that sorts first. Repeated rows give repeated
    results, an empty table an empty one. Very long texts and runs of letters
    are scored whole. Further columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts_of(batches):
            pred, share = classify(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(share, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents with a language (not ``und``) that has at least ``least`` of the likelihood; columns as they are."""

    at = docs.columns.index("text")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts_of(batches, at):
            pred, share = classify(batch.column(at), model)
            yield batch.filter(pa.array([p != "und" and s >= least for p, s in zip(pred, share.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(chosen, docs.schema)


def held_out() -> Column:
    """True for every fifth document by its doc_id; false for a null doc_id, from which nothing is learned either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, one row for each row; learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, F.col("doc_id").isNotNull() & ~held_out())
    found = identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
