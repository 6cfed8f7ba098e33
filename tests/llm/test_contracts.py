"""Every numbered query and the pipeline: columns and types, and tables with nulls, ties, repeats, clashing columns or no rows."""

import inspect

import pytest

from gleaner.llm import registry

LONG, STRING, DOUBLE, BOOLEAN, INT = "bigint", "string", "double", "boolean", "int"
CONTRACTS = {
    "op1_embedding_dedup": ("embeddings", {"vec_id": LONG, "n_links": LONG, "component_id": LONG, "kept": BOOLEAN}),
    "op2_simhash": ("documents", {"doc_id": LONG, "fingerprint": STRING, "component_id": LONG}),
    "op3_license_scan": ("documents", {"doc_id": LONG, "n_words": LONG, "n_base": LONG, "first_word": LONG, "last_word": LONG, "base_labels": STRING, "labels": STRING, "score": DOUBLE}),
    "op4_sentencepiece": ("documents", {"doc_id": LONG, "n_tokens": LONG, "ids_crc32": LONG, "round_trip": BOOLEAN}),
    "op5_packing": ("documents", {"doc_id": LONG, "piece": INT, "start": LONG, "length": LONG, "ids_crc32": LONG, "sequence_id": LONG, "offset": LONG}),
    "op6_language_id": ("documents", {"doc_id": LONG, "held_out": BOOLEAN, "lang_pred": STRING, "score": DOUBLE}),
    "op7_line_dedup": ("documents", {"doc_id": LONG, "n_lines": LONG, "n_dropped": LONG, "kept_sha256": STRING}),
    "op8_html_text": ("pages", {"page_id": LONG, "url": STRING, "text": STRING, "n_chars": LONG}),
    "op9_url_filter": ("pages", {"page_id": LONG, "host": STRING, "path": STRING, "rule": STRING, "verdict": STRING}),
    "op10_quality_rules": ("documents", {"doc_id": LONG, "n_words": LONG, "word_chars": LONG, "n_symbols": LONG, "n_dup_lines": LONG, "n_repeat_words": LONG, "base_failed": BOOLEAN, "kept": BOOLEAN}),
    "op11_importance_resampling": ("documents", {"doc_id": LONG, "n_features": LONG, "weight": LONG, "score": LONG, "rank": LONG}),
    "op12_exact_dedup": ("documents", {"doc_id": LONG, "keep_id": LONG, "group_size": LONG, "kept": BOOLEAN, "text_sha256": STRING}),
    "op13_token_alignment": ("documents", {"doc_id": LONG, "n_a": LONG, "n_b": LONG, "n_groups": LONG, "n_links": LONG, "n_best": LONG, "count_sum": LONG, "groups_sha256": STRING}),
}
SAME = "a line that two texts share here\nand one more"
TEXTS = [None, "", " \n\t", "one", SAME, SAME, SAME.upper(), "é" * 5000, "the and of " * 4000, "Licensed under the Apache License, Version 2.0."]
CLASHES = ["1 as fp", "2 as rep", "3 as component", "4 as version", "5 as words", "6 as h", "7 as lines", "8 as `row`", "9 as stats", "10 as s", "11 as score", "12 as item", "13 as length", "14 as piece"]


def write(spark, folder, rows):
    docs = [(i, t, "en" if i % 2 else None, f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    docs = [*docs, docs[4], (None, SAME, None, None, None), (None, None, "en", "s1", 0)] if rows else []
    page = "<article><h1>Title</h1><p>Some words of text.</p></article>"
    pages = [(1, "http://a.net/x", page), (1, "http://a.net/x", page), (2, None, None), (None, "", ""), (3, "no scheme", "plain"), (4, "https://free-bets.net/1", "<nav><a href=x>m</a></nav>")] if rows else []
    vectors = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [1.0, None], 1), (8, [1.0, 0.0], None), (None, [1.0, 0.0], 1)] if rows else []
    labels = [(4, 1, 0), (4, 1, 0), (8, 0, 0), (9, 1, 0), (None, 0, 0), (3, None, None)] if rows else []
    extra = lambda df: df.selectExpr("*", *CLASHES)
    made = {
        "documents": extra(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")),
        "pages": extra(spark.createDataFrame(pages, "page_id long, url string, html string")),
        "embeddings": extra(spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        "benchmark": extra(spark.createDataFrame([(1, SAME), (2, None), (None, "")] if rows else [], "item_id long, text string")),
    }
    for name, df in made.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return {name: df.count() for name, df in made.items()}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    odd, empty = (str(tmp_path_factory.mktemp(x)) for x in ("odd", "empty"))
    return {"odd": (odd, write(spark, odd, True)), "empty": (empty, write(spark, empty, False))}


@pytest.mark.parametrize("name", CONTRACTS)
@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_query(spark, tables, name, kind):
    folder, sizes = tables[kind]
    source, columns = CONTRACTS[name]
    out = registry.QUERIES[name](spark, folder)
    got = dict(out.dtypes)
    assert {c: got.get(c) for c in columns} == columns
    rows = out.collect()
    if name == "op5_packing":
        assert sum(r.piece == 0 for r in rows) == sizes[source]
    else:
        assert len(rows) == sizes[source]
    again = registry.QUERIES[name](spark, folder).collect()
    if name != "op5_packing":  # whose sequences have any numbers
        assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_values_of_odd_rows(spark, tables):
    folder = tables["odd"][0]
    at = lambda name, key="doc_id": {r[key]: r for r in registry.QUERIES[name](spark, folder).collect() if r[key] is not None}
    simhash = at("op2_simhash")
    assert simhash[0].fingerprint == simhash[1].fingerprint == "0" * 16 and [simhash[i].component_id for i in (0, 1, 2, 4, 5, 6)] == [0, 0, 0, 4, 4, 4]
    lines = at("op7_line_dedup")
    assert (lines[0].n_lines, lines[5].n_dropped, lines[4].n_dropped) == (1, 2, 0)
    assert at("op3_license_scan")[9].labels == "apache,apache-2"
    vectors = at("op1_embedding_dedup", "vec_id")
    assert (vectors[1].n_links, vectors[2].component_id, vectors[2].kept, vectors[3].n_links) == (1, 1, False, 0)
    pages = at("op8_html_text", "page_id")
    assert pages[1].text == "Title Some words of text." and pages[2].text == "" and pages[2].n_chars == 0
    assert [at("op6_language_id")[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3
    quality = at("op10_quality_rules")
    assert quality[0].base_failed and not quality[0].kept and quality[8].base_failed


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_pipeline(spark, tables, kind):
    import corpus_pipeline

    folder, sizes = tables[kind]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() <= sizes["documents"], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).where("piece = 0").count() == sizes["documents"]
    assert corpus_pipeline.run(spark, folder).count() <= 2 * sizes["documents"]


def test_docstrings():
    for name in CONTRACTS:
        assert inspect.getdoc(registry.QUERIES[name]), name
