"""Profiles over runs: each field's rule, and a second run that brings nothing new."""

import pytest

from gleaner.operators import profiles

SCHEMA = "company string, checked_at string, " + ", ".join(f"{c} {t}" for c, t in profiles.PROFILE.items())


def profile(company, at, **given):
    return (company, at, *(given.get(c) for c in profiles.PROFILE))


def activity(concept, strength, *urls, related=False, label="L", kind="product"):
    return (kind, concept, label, related, strength, [(u, f"q {u}") for u in urls])


@pytest.fixture(scope="module")
def tables(spark):
    stored = [
        profile(
            "a", "t1", name="Oud", phone="1", trade_names=["x", "y"], kvk="1", stated_kvk="7", stated_on="p1", sources=[("p1", "t1"), ("p2", "t1")], areas=[("place", "Delft")],
            activities=[activity("c1", "strong", "p1"), activity("c2", "strong", "p1", "p2"), activity("c3", "weak", "p1"), activity(None, "weak", "p1", label="vrij")],
            types=[("shop", "weak"), ("maker", "strong")], locations=[("Weg 1", "1111 AA", "delft", None), (None, None, "Gouda", "ZH")], changes=[("name", "Eerst", "Oud", "t0")],
        ),
        profile("gone", "t1", name="Blijft"),
    ]
    incoming = [
        profile(
            "a", "t2", name="Nieuw", email="a@b.nl", trade_names=["y", "z"], kvk="2", stated_kvk="8", stated_on="p3", sources=[("p2", "t2"), ("p3", "t2"), ("p3", "t2")], areas=[("place", "Delft"), ("national", "NL")],
            activities=[activity("c1", "weak", "p1", "p3"), activity("c2", "weak", "p2", "p3"), activity("c3", "strong", *[f"n{i}" for i in range(9)]), activity("c1", "weak", "p9", related=True), activity(None, "strong", "p3", label="vrij")],
            types=[("shop", "strong"), ("maker", "weak"), ("b2b", "weak")], locations=[("Weg 1", "1111 AA", "Delft", "ZH"), (None, None, "Gouda", None), (None, None, "Ede", None)],
        ),
        profile("fresh", "t2", name="Vers"),
    ]
    return spark.createDataFrame(stored, SCHEMA), spark.createDataFrame(incoming, SCHEMA)


def test_update(tables):
    got = {r.company: r for r in profiles.update_profiles(*tables).collect()}
    a = got["a"]
    assert (a.name, a.phone, a.email, a.kvk, a.stated_kvk, a.stated_on, a.checked_at) == ("Nieuw", "1", "a@b.nl", "1", "8", "p3", "t2")
    assert [(c.field, c.previous, c.current, c.at) for c in a.changes] == [("name", "Eerst", "Oud", "t0"), ("name", "Oud", "Nieuw", "t2"), ("registration", "7", "8", "t2")]
    found = {(x.concept, x.label, x.related): (x.strength, [e.url for e in x.evidence]) for x in a.activities}
    assert found["c1", "L", False] == ("weak", ["p1", "p3"])  # its only page was read again
    assert found["c2", "L", False] == ("strong", ["p1", "p2", "p3"])  # p1 was not
    assert found["c3", "L", False] == ("strong", ["p1", "n0", "n1", "n2", "n3"])
    assert found["c1", "L", True] == ("weak", ["p9"]) and found[None, "vrij", False] == ("strong", ["p1", "p3"])
    assert [(t.type, t.strength) for t in a.types] == [("shop", "strong"), ("maker", "strong"), ("b2b", "weak")]
    assert [(x.city, x.province) for x in a.locations] == [("Delft", "ZH"), ("Gouda", "ZH"), ("Ede", None)]
    assert a.trade_names == ["x", "y", "z"] and [(x.scope, x.value) for x in a.areas] == [("place", "Delft"), ("national", "NL")]
    assert [(s.url, s.checked_at) for s in a.sources] == [("p1", "t1"), ("p2", "t2"), ("p3", "t2")]
    assert a.changed and not a.is_new and not got["gone"].changed and got["gone"].name == "Blijft" and got["fresh"].is_new and got["fresh"].changed


def test_nothing_new(tables):
    once = profiles.update_profiles(*tables)
    again = profiles.update_profiles(once.drop("changed", "is_new"), tables[1])
    assert not any(r.changed or r.is_new for r in again.collect())
    strip = lambda df: sorted(map(repr, df.drop("changed", "is_new").collect()))
    assert strip(again) == strip(once)


def test_bounds(spark):
    stored = spark.createDataFrame([profile("a", "t1", changes=[("name", str(i), str(i + 1), "t") for i in range(50)], name="50", sources=[(f"p{i}", "t1") for i in range(60)])], SCHEMA)
    incoming = spark.createDataFrame([profile("a", "t2", name="51", sources=[("new", "t2")])], SCHEMA)
    r = profiles.update_profiles(stored, incoming).collect()[0]
    assert len(r.changes) == 50 and r.changes[-1].current == "51" and r.changes[0].previous == "1" and len(r.sources) == 60
    assert profiles.update_profiles(stored.limit(0), incoming.limit(0)).count() == 0


def test_many_activities(spark):
    """A company with thousands of activities: each new one meets its stored one by its key."""
    n = 3000
    half = n // 2
    stored = [activity(f"c{i}", "weak", f"p{i}") for i in range(n)]
    incoming = [activity(f"c{i}", "strong", f"q{i}") for i in range(half, n + half)] + [activity(f"c{half}", "weak", "twice"), activity(None, "strong", "own", label="L"), activity(None, "weak", "own", label="vrij"), activity(None, "weak", "later", label="vrij")]
    tables = [spark.createDataFrame([profile("a", at, activities=a)], SCHEMA) for at, a in (("t1", stored), ("t2", incoming))]
    found = profiles.update_profiles(*tables).collect()[0].activities
    assert [a.concept for a in found] == [f"c{i}" for i in range(n + half)] + [None]
    # the new one without a concept is the first that those of its label meet, where no new one has their concept
    assert (found[0].strength, [e.url for e in found[0].evidence]) == ("strong", ["p0", "own"])
    assert (found[half].strength, [e.url for e in found[half].evidence]) == ("strong", [f"p{half}", f"q{half}"])
    assert (found[n].strength, found[-1].label, [e.url for e in found[-1].evidence]) == ("strong", "vrij", ["own"])
