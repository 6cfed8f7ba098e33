"""Importance resampling, exact dedup and token alignment against brute force, odd rows included."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gleaner.llm import alignment, exact_dedup, importance

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    words = ["the", "and", "Holz", "née", "x1", "日本語", "a,b", "ß", "😀"]
    made = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(40)]
    odd = [None, "", " ", "\n", "  two  spaces ", "tab\t \tx", "a\r\n b", " nbsp  x ", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b c", "▁", "x\x00y", "=" * 70, "aaaa" * 30, "zeile  end\x85 x\x1c y", "the " * 25, "é" * 500, "q\n\n \n  w"]
    return odd + made + made[:5] + [made[0].upper()]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (20, texts[20]), (20, texts[21]), (None, texts[20]), (None, "only here"), (None, "ONLY here")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as kept", "3 as number", "4 as bucket", "5 as pair", "6 as block").repartition(3)


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_importance(spark, docs):
    target = spark.createDataFrame([("the and Holz",), (None,), ("née the",)], "text string")
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    grams = lambda w: [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]
    of = lambda f: zlib.crc32(f.encode()) % 10000
    rows = [(r.doc_id, words(r.text)) for r in docs.collect()]
    s = collections.Counter(of(f) for _, w in rows for f in grams(w))
    t = collections.Counter(of(f) for r in target.collect() for f in grams(words(r.text)))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000)))) for b in s}
    want = []
    for i, w in rows:
        f = grams(w)
        weight = sum(gain[of(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        want.append([i, len(f), weight, score, i is not None and len(w) >= 20])
    can = sorted((r for r in want if r[4]), key=lambda r: (-r[3], r[0]))
    drawn = len(can) * 25 // 100
    assert drawn > 5
    for n, r in enumerate(can):
        r[4] = n + 1 if n < drawn else None
    got = importance.resample(docs, target)
    ranks = sorted(r["rank"] for r in got.collect() if r["rank"])
    assert ranks == list(range(1, drawn + 1))
    assert rows_of(got) == sorted(repr((*r[:4], r[4] or None)) for r in want)
    kept = importance.keep_drawn(docs, target)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in can[:drawn]}
    empty = docs.limit(0)
    assert importance.resample(empty, target).count() == importance.resample(empty, target.limit(0)).count() == 0
    assert importance.resample(docs, target.limit(0)).count() == docs.count()


def test_importance_plan(spark, docs):
    plan = importance.scores(docs, docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("split(") == 1


def test_ranked_over_many_partitions(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("a"), F.col("id").alias("row"))
    got = importance.ranked(rows, [F.col("a").desc(), F.col("row").asc()]).collect()
    want = {r: i + 1 for i, (_, r) in enumerate(sorted((-(i % 7), i) for i in range(5000)))}
    assert {r["row"]: r["rank"] for r in got} == want and {r["of"] for r in got} == {5000}


@pytest.mark.parametrize("sizes", [(64, 16, 1 << 20), (2, 6, 256)])
def test_exact_dedup(spark, docs, sizes):
    long = "begin " * 30
    more = spark.createDataFrame([(i, t) for i, t in enumerate([long + "a", long + "b", long + "A", "x" * 64, "x" * 65, "X" * 64, "x" * 63 + "é", "É", "é"], 500)], "doc_id long, text string")
    all_docs = docs.unionByName(more, allowMissingColumns=True)
    rows = all_docs.collect()
    same = collections.defaultdict(list)
    for r in rows:
        same[(r.text or "").translate(LOWER)].append(r.doc_id)
    got = exact_dedup.mark_copies(all_docs, *sizes)
    assert got.columns == [c for c in docs.columns if c != "kept"] + ["keep_id", "group_size", "kept"]
    found = collections.defaultdict(list)
    for r in got.collect():
        ids = same[(r.text or "").translate(LOWER)]
        assert r.keep_id == max((i for i in ids if i is not None), default=None) and r.group_size == len(ids)
        found[(r.text or "").translate(LOWER)].append((r.kept, r.doc_id == r.keep_id))
    assert {t: len(x) for t, x in found.items()} == {t: len(x) for t, x in same.items()}
    assert all([k for k, _ in x].count(True) == 1 and all(is_it for k, is_it in x if k) for x in found.values())


def test_exact_dedup_ends(spark, docs):
    assert exact_dedup.mark_copies(docs.limit(0)).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.text or "").translate(LOWER) for r in kept.collect()) == sorted({(r.text or "").translate(LOWER) for r in docs.collect()})


def brute_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    path_a, path_b = alignment.paths()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=path_b)
    signs = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(x): x for x in signs} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in signs)}
    out, held = [], collections.Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append(([], [], [], []))
            continue
        ends = []
        for tokens in (bytes_a, bytes_b):
            at, own = 0, []
            for t in tokens:
                at += len(t)
                own.append(at)
            ends.append(own)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, start = [], 0
        for cut in cuts:
            groups.append(tuple([i for i, e in zip(ids, own, strict=True) if start < e <= cut] for ids, own in zip((ids_a, ids_b), ends, strict=True)))
            start = cut
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        held.update(set(links))
        out.append((ids_a, ids_b, groups, links))
    best = collections.defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    rows = []
    for ids_a, ids_b, groups, links in out:
        said = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)
        rows.append((len(ids_a), len(ids_b), len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return rows


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.mark.parametrize("block", [6 << 20, 200])
def test_alignment(spark, docs, block):
    rows = docs.collect()
    want = sorted(repr((r.doc_id, *w)) for r, w in zip(rows, brute_alignment([r.text for r in rows]), strict=True))
    assert rows_of(alignment.align_corpus(docs, block_bytes=block).select("doc_id", *COLUMNS)) == want
    assert alignment.align_corpus(docs.limit(0)).count() == 0


def test_alignment_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    want = sorted(repr((r.doc_id, *w)) for r, w in zip(rows, brute_alignment([r.text for r in rows]), strict=True))
    assert rows_of(alignment.op13_token_alignment(spark, SF).select("doc_id", *COLUMNS[:-1], "groups_sha256")) == want


def test_wide_groups(spark, monkeypatch):
    a, b = alignment.coders(*alignment.paths())
    words = ["plain", "=" * 500, "日本語のテキスト", "a" * 300, ""]
    usual = alignment.Aligned(words, a, b).links()
    monkeypatch.setattr(alignment, "WIDE", 0)
    wide = alignment.Aligned(words, a, b).links()
    totals = []
    for word, pair, times in (usual, wide):
        count = collections.Counter()
        for key, n in zip(zip(word.tolist(), pair.tolist(), strict=True), times.tolist(), strict=True):
            count[key] += n
        totals.append(count)
    assert totals[0] == totals[1] and sum(totals[0].values()) >= len(words)


def test_overlaps(spark):
    a, b = alignment.coders(*alignment.paths())
    aligned = alignment.Aligned(["word"], a, b)
    ends = [{int(c.lengths[ids[: n + 1]].sum()) for n in range(len(ids))} for c, ids in ((a, aligned.a.tolist()), (b, aligned.b.tolist()))]
    assert aligned.n_overlaps[0] == len(ends[0] | ends[1]) and aligned.n_groups[0] == len(ends[0] & ends[1])
