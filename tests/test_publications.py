"""The log of publications: two runs give what one run over both gives, compacted or not."""

import pytest

from gleaner.operators import publications as P
from gleaner.operators.storage import new_path

SCHEMA = "tender string, publication_id string, published string, discovery string, title string, codes array<string>"
FIRST = [("t1", "1", "2024-01-01", "api", "Weg", ["a"]), ("t1", "2", "2024-02-01", "api", None, []), ("t2", "9", None, "site", "Brug", None), ("t2", "10", None, "site", None, ["b"]), ("t4", "1", "2024-01-01", "api", "Blijft", ["z"])]
SECOND = [("t1", "3", "2024-03-01", "mail", None, ["c"]), ("t1", "1", "2024-01-01", "mail", "Weg nieuw", ["a"]), ("t2", "9", None, "mail", "Brug", None), ("t3", "1", "2024-01-05", "mail", "Dak", None), ("t3", "1", "2024-01-05", "mail", "Dak", None)]


@pytest.fixture(scope="module")
def folder(spark):
    path = new_path(spark, "log")
    P.append(spark.createDataFrame(FIRST, SCHEMA), path, 1)
    P.append(spark.createDataFrame(SECOND, SCHEMA), path, 2)
    return path


def rows(df):
    return sorted(map(repr, df.drop("seen", "first_seen", "last_new").collect()))


def test_facts(spark, folder):
    got = {r.tender: r for r in P.facts(P.publications(spark, folder), ["title", "codes"]).collect()}
    one = got["t1"]
    assert (one.title, one.codes, one.publication_id, one.published, one.discovery, one.publications) == ("Weg nieuw", ["c"], "3", "2024-03-01", "api", ["1", "2", "3"])
    assert (got["t2"].publications, got["t2"].title, got["t2"].codes, got["t2"].publication_id) == (["9", "10"], "Brug", ["b"], "10")
    assert got["t3"].discovery == "mail" and len(got) == 4


def test_two_runs_are_one(spark, folder):
    whole = new_path(spark, "log")
    P.append(spark.createDataFrame([r for r in FIRST if (r[0], r[1]) not in {(s[0], s[1]) for s in SECOND}] + SECOND, SCHEMA), whole, 1)
    two, one = (P.facts(P.publications(spark, f), ["title", "codes"]).drop("discovery") for f in (folder, whole))
    assert rows(two) == rows(one)


def test_update(spark, folder):
    got = {r.tender: (r.status, r.added) for r in P.update(P.publications(spark, folder, 1), P.publications(spark, folder), ["title", "codes"], 2).collect()}
    assert got == {"t1": ("updated", 1), "t2": ("unchanged", 0), "t3": ("new", 1), "t4": ("unchanged", 0)}


def test_compaction(spark, folder):
    before = rows(P.publications(spark, folder)), rows(P.facts(P.publications(spark, folder), ["title", "codes"]))
    P.compact(spark, folder, 1)
    assert (rows(P.publications(spark, folder)), rows(P.facts(P.publications(spark, folder), ["title", "codes"]))) == before
    P.compact(spark, folder, 2)
    assert (rows(P.publications(spark, folder)), rows(P.facts(P.publications(spark, folder), ["title", "codes"]))) == before
    with pytest.raises(ValueError, match="compacted"):
        P.publications(spark, folder, 1)
    P.append(spark.createDataFrame([("t4", "2", "2025-01-01", "mail", "Nieuw", None)], SCHEMA), folder, 3)
    last = {r.tender: r.title for r in P.facts(P.publications(spark, folder), ["title", "codes"]).collect()}
    assert last["t4"] == "Nieuw" and len(last) == 4
