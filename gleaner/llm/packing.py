"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents become pieces of at most ``CAPACITY`` tokens. Pieces are dealt by hash
into shards of about ``SHARD_PIECES``; a few islands evolve packings of each
shard, every island a Spark group of its own. A solution's genes are whole bins:
crossover injects the well-filled bins of one parent into the other, removes the
bins they make incomplete and puts the displaced pieces back: first in exchange
for smaller pieces of bins that they fill better, the rest by best fit.
A shard whose packing meets the lower bound is done; only the others are searched further.
Between epochs each island's elite migrates to the next. Bins that even the
best packing leaves unfilled are dissolved, and their pieces meet those of other
shards on the next level.
"""

from __future__ import annotations

import codecs
import os
import random
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.storage import materialize

from .common import table
from .word_codes import WordCodes, slices

CAPACITY = 4096
END = 1
SHARD_PIECES = 1024
ISLANDS = 2
EPOCHS = 3
#: Of an epoch, for shards above their lower bound.
GENERATIONS = 16
POPULATION = 8
#: Pairs of displaced pieces are tried in exchanges while no more than so many pieces are displaced; single ones always.
PAIRED = 48
#: A bin at least so full is final; emptier ones go to the next level.
FULL = 0.99
LEVELS = 4


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Latin letters, without those whose lower case is more than one character.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ɏ"
LATIN = re.compile(f"[{LETTERS}]+")
#: How byte-level tokenizers write bytes: printable ones as they are, the others from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_SPELLED = "".join(chr(BYTE_SIGNS.get(b, b)) for b in range(256))
#: A letter and a character that the tokenizer parts from letters before it.
MARKED = rf"([{LETTERS}])([.,;:!?#*$%&|<>()\[\]{{}}\"/=+@^~`])"
#: What all special tokens begin with; their spelling counts.
SPECIAL = "<|"
#: Parts whose ids a Python worker keeps, at about 200 bytes each; a batch has some 80,000.
KNOWN_PARTS = 500_000


def parts_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Text numbers and parts, whose ids in turn are those of the texts.

    Words are parted at white space and before marks that follow a letter, as the tokenizer does itself, and those
    of ASCII alone are in lower case, as it reads them; with other characters a lower letter may compose otherwise.
    """
    texts = pc.fill_null(texts, "")
    spaced = pc.replace_substring_regex(texts, pattern=MARKED, replacement=r"\1 \2")
    words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, SPECIAL), texts, spaced))
    flat = pc.list_flatten(words)
    plain = pc.and_not(pc.string_is_ascii(flat), pc.match_substring(flat, SPECIAL))
    return np.asarray(pc.list_parent_indices(words)), pc.if_else(plain, pc.ascii_lower(flat), flat)


def word_codes(path: str) -> WordCodes:
    """Encoder of words, by the tokenizer in ``path``.

    The tokenizer normalises by character and drops white space before it looks
    for tokens, so the ids of a text are those of its ASCII-space-separated parts in turn.
    """
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model

    def encode_parts(parts: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(parts)
        rest = []
        for i, part in enumerate(parts):
            # of letters only, it is one pre-token: the model alone gives its ids
            if part.isascii() and part.isalpha():
                spelled = part.lower()
            elif LATIN.fullmatch(part) and unicodedata.is_normalized("NFC", part):
                spelled = codecs.charmap_decode(part.lower().encode(), "strict", _SPELLED)[0]
            else:
                rest.append(i)
                continue
            out[i] = [t.id for t in model.tokenize(spelled)]
        encoded = tokenizer.encode_batch_fast([parts[i] for i in rest], add_special_tokens=False)
        for i, e in zip(rest, encoded, strict=True):
            out[i] = e.ids
        return out

    return WordCodes(encode_parts, KNOWN_PARTS)


_encoders: dict[str, WordCodes] = {}


def tokenize(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every piece. A null text is empty: it has the end token alone."""
    path = path or tokenizer_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = word_codes(path)
        for batch in batches:
            for at, n in slices(batch.column("text")):
                part = batch.slice(at, n)
                ids, starts = _encoders[path].expand(*parts_of(part.column("text")), n)
                row, piece, start, length, pieces = [], [], [], [], []
                for i in range(n):
                    own = np.append(ids[starts[i] : starts[i + 1]], np.uint32(END))
                    for k, s in enumerate(range(0, len(own), capacity)):
                        cut = own[s : s + capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(len(cut))
                        pieces.append(cut.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(row, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(pieces, pa.binary()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids binary"
    )


class Packing:
    """Bins of piece numbers, with the room left in each."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0  # bit r is set if a bin has room r

    def _place(self, b: int) -> None:
        r = self.room[b]
        self.by_room.setdefault(r, []).append(b)
        self.rooms |= 1 << r

    def open(self, members: list[int]) -> None:
        self.bins.append(members)
        self.room.append(self.capacity - sum(self.sizes[i] for i in members))
        self._place(len(self.bins) - 1)

    def best_fit(self, items: list[int]) -> None:
        """Put each piece where it leaves least room, or into a new bin."""
        for i in items:
            size = self.sizes[i]
            fitting = self.rooms >> size
            if not fitting:
                self.open([i])
                continue
            r = size + (fitting & -fitting).bit_length() - 1
            same = self.by_room[r]
            b = same.pop()
            if not same:
                self.rooms ^= 1 << r
            self.bins[b].append(i)
            self.room[b] = r - size
            self._place(b)

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then uneven filling: full bins beside empty ones are worth more than level ones."""
        return -len(self.bins), sum((self.capacity - r) ** 2 for r in self.room)


def _from(bins: list[list[int]], sizes: list[int], capacity: int) -> Packing:
    out = Packing(sizes, capacity)
    for members in bins:
        out.open(list(members))
    return out


def _exchange(bins: list[list[int]], loose: list[int], sizes: list[int], capacity: int, rng: random.Random) -> list[int]:
    """Displaced pieces, one or two, take the place of one or two smaller ones of a bin that they fill better.

    Bins are changed in place; what is displaced then is returned. Each exchange fills its bin as far as any can.
    """
    for k in rng.sample(range(len(bins)), len(bins)):
        members = bins[k]
        room = capacity - sum(sizes[i] for i in members)
        if not room or not loose:
            continue
        sums = sorted([(sizes[i], (i,)) for i in loose])
        if len(loose) <= PAIRED:
            sums = sorted(sums + [(sizes[i] + sizes[j], (i, j)) for i, j in combinations(loose, 2)])
        keys = [x for x, _ in sums]
        out_of = [(i,) for i in members] + (list(combinations(members, 2)) if len(members) <= 6 else [])
        best, better = 0, None
        for out in out_of:
            had = sum(sizes[i] for i in out)
            at = bisect_right(keys, had + room) - 1
            if at >= 0 and keys[at] - had > best:
                best, better = keys[at] - had, (out, sums[at][1])
        if better:
            out, in_ = better
            bins[k] = [i for i in members if i not in out] + list(in_)
            loose = [i for i in loose if i not in in_] + list(out)
    return loose


def _cross(a: Packing, b: Packing, rng: random.Random) -> Packing:
    """Well-filled bins of ``b`` enter ``a``; bins that lose a piece to them are dissolved, as are a few of a's emptiest."""
    order = sorted(range(len(b.bins)), key=b.room.__getitem__)
    good = [b.bins[k] for k in order[: max(1, len(order) // 2)]]
    injected = rng.sample(good, max(1, len(good) // 3))
    taken = {i for m in injected for i in m}
    emptiest = set(sorted(range(len(a.bins)), key=a.room.__getitem__)[-rng.randint(1, 3) :])
    stay, loose = [], []
    for k, m in enumerate(a.bins):
        if k in emptiest or not taken.isdisjoint(m):
            loose.extend(i for i in m if i not in taken)
        else:
            stay.append(list(m))
    bins = [list(m) for m in injected] + stay
    loose = _exchange(bins, loose, a.sizes, a.capacity, rng)
    child = _from(bins, a.sizes, a.capacity)
    child.best_fit(sorted(loose, key=lambda i: (-a.sizes[i], i)))
    return child


def evolve(
    sizes: list[int], capacity: int, seed: int, start: list[list[list[int]]], generations: int = GENERATIONS
) -> list[Packing]:
    """The final population, best first. ``start`` holds solutions to begin with."""
    rng = random.Random(seed)
    falling = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    least = -(-sum(sizes) // capacity)
    people = [_from(bins, sizes, capacity) for bins in start]
    if not people:
        people.append(Packing(sizes, capacity))
        people[0].best_fit(falling)
    done = min(len(p.bins) for p in people) <= least
    while len(people) < (2 if done else POPULATION):
        p = Packing(sizes, capacity)
        p.best_fit(sorted(falling, key=lambda i: -sizes[i] * rng.uniform(0.7, 1.0)))
        people.append(p)
    people.sort(key=Packing.fitness, reverse=True)
    for _ in range(generations):
        if len(people[0].bins) <= least:
            break
        a, b = rng.sample(people, 2)
        for child in (_cross(a, b, rng), _cross(b, a, rng)):
            if all(child.fitness() != p.fitness() for p in people):  # equal ones would crowd out the others
                people.append(child)
        people.sort(key=Packing.fitness, reverse=True)
        del people[POPULATION:]
    return people


def _solutions(group: pd.DataFrame) -> tuple[list[int], list[int], list[list[list[int]]]]:
    """Pieces in order, their sizes, and the packings of the group, each of which holds all pieces."""
    first = group[group["solution"] == group["solution"].min()].sort_values("item")
    items = first["item"].tolist()
    place = {item: i for i, item in enumerate(items)}
    found = []
    for _, rows in group.groupby("solution"):
        bins: dict[int, list[int]] = {}
        for item, b in zip(rows["item"].tolist(), rows["bin"].tolist(), strict=True):
            bins.setdefault(b, []).append(place[item])
        found.append(list(bins.values()))
    return items, first["length"].tolist(), found


_STATE = "shard long, island int, solution int, item long, length long, bin int"
_PLACED = "shard long, item long, length long, bin int, sequence_id long, offset long"
#: Instead of a sequence's number: its bin is to be dissolved, or the shard is to be searched further.
DISSOLVED, OPEN = -1, -2


def _rows(packing: Packing, items: list[int]) -> dict[str, list[int]]:
    pairs = [(i, b) for b, m in enumerate(packing.bins) for i in m]
    return {"item": [items[i] for i, _ in pairs], "length": [packing.sizes[i] for i, _ in pairs], "bin": [b for _, b in pairs]}


def _places(rows: pd.DataFrame, shard: int, capacity: int, level: int, last: bool) -> pd.DataFrame:
    """``_PLACED`` of the bins of a shard that are final, and ``DISSOLVED`` for the pieces of the others."""
    rows = rows.sort_values(["bin", "item"]).reset_index(drop=True)
    fill = rows.groupby("bin")["length"].transform("sum")
    offset = rows.groupby("bin")["length"].cumsum() - rows["length"]
    final = (fill >= FULL * capacity) | last
    sequence = (level << 58) + (shard << 24) + rows["bin"].astype("int64")
    return pd.DataFrame(
        {
            "shard": shard,
            "item": rows["item"],
            "length": rows["length"],
            "bin": rows["bin"],
            "sequence_id": sequence.where(final, DISSOLVED),
            "offset": offset.where(final, DISSOLVED),
        }
    )


def _seed(capacity: int, level: int, last: bool):
    """Best fit decreasing: where it meets the lower bound the shard is done, else its packing starts the search."""

    def step(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        group = group.sort_values("item")
        items, sizes = group["item"].tolist(), group["length"].tolist()
        packing = Packing(sizes, capacity)
        packing.best_fit(sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)))
        rows = pd.DataFrame(_rows(packing, items))
        if len(packing.bins) > -(-sum(sizes) // capacity):
            return rows.assign(shard=shard, sequence_id=OPEN, offset=OPEN)
        return _places(rows, shard, capacity, level, last)

    return step


def _epoch(number: int, capacity: int, islands: int):
    def step(group: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(group["shard"].iloc[0]), int(group["island"].iloc[0])
        items, sizes, start = _solutions(group)
        people = evolve(sizes, capacity, (shard * 31 + island) * 31 + number, start)
        # the two best stay; the best also goes to the next island
        keep = [(island, 0, people[0]), (island, 1, people[1])]
        if islands > 1:
            keep.append(((island + 1) % islands, 2, people[0]))
        return pd.concat([pd.DataFrame({"shard": shard, "island": where, "solution": n, **_rows(p, items)}) for where, n, p in keep])

    return step


def _settle(capacity: int, level: int, last: bool):
    """The best of all islands' packings of a shard."""

    def step(group: pd.DataFrame) -> pd.DataFrame:
        best = None
        for _, rows in group.groupby(["island", "solution"]):
            fills = rows.groupby("bin")["length"].sum().to_numpy(np.int64)
            value = (-len(fills), int((fills**2).sum()))
            if best is None or value > best[0]:
                best = (value, rows)
        return _places(best[1], int(group["shard"].iloc[0]), capacity, level, last)

    return step


def pack(items: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(item, sequence_id, offset) for rows of (item, length), 1 <= length <= capacity.

    ``item`` is unique. Every piece gets a place; the places of a sequence leave no gap. Pieces of equal length
    are told apart by their number only. An empty table gives an empty one.
    """
    done, left = [], items
    count = left.count()
    for level in range(LEVELS):
        shards = max(1, -(-count // shard_pieces))
        last = shards == 1 or level == LEVELS - 1
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
        found = materialize(dealt.groupBy("shard").applyInPandas(_seed(capacity, level, last), _PLACED), "seeded")
        hard = found.where(F.col("sequence_id") == OPEN)
        if not hard.isEmpty():
            islands = F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))).alias("island")
            state = hard.select("shard", islands, F.lit(0).alias("solution"), "item", "length", "bin")
            for epoch in range(EPOCHS):
                state = state.groupBy("shard", "island").applyInPandas(_epoch(epoch, capacity, ISLANDS), _STATE)
            searched = state.groupBy("shard").applyInPandas(_settle(capacity, level, last), _PLACED)
            found = found.where(F.col("sequence_id") != OPEN).unionByName(materialize(searched, "searched"))
        done.append(found.where("sequence_id >= 0").select("item", "sequence_id", "offset"))
        if last:
            break
        left = found.where(F.col("sequence_id") == DISSOLVED).select("item", "length")
        count = left.count()
        if not count:
            break
    return reduce(DataFrame.unionByName, done)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset
    and, if asked for, ids (little-endian unsigned 32-bit numbers).

    A null or empty text is one piece of the end token. Very long texts are encoded whole and cut into pieces of
    ``capacity``. Repeated rows and rows without doc_id are packed each. An empty table gives an empty one. Other
    columns of ``docs``, whatever their names, are not read.
    """
    cut = tokenize(docs, path, capacity).withColumn("ids_crc32", F.crc32("ids"))
    if not ids:
        cut = cut.drop("ids")
    pieces = materialize(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")
    places = pack(pieces.select("item", "length"), capacity)
    return pieces.join(places, "item").drop("item")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places, without the ids."""
    return pack_documents(table(spark, sf_dir, "documents"), ids=False)
