"""Company profiles kept over runs: what a later run found is merged into what is stored, field by field.

A profile is a row whose lists are arrays of structs, each with a bound of its own, so
a merge is a join on the company and expressions over its two rows. Nothing that was
found earlier is dropped; a value that reads differently leaves its former one in ``changes``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields with one value, and how many entries of a list are kept.
SINGLE = ["name", "description", "phone", "email", "contact_url"]
TRADE_NAMES, LOCATIONS, AREAS, SOURCES, EVIDENCE, CHANGES = 8, 15, 20, 60, 5, 50
#: The columns of a profile besides the company and the moment it was checked.
PROFILE = {
    **{f: "string" for f in SINGLE},
    "trade_names": "array<string>",
    "activities": "array<struct<kind:string,concept:string,label:string,related:boolean,strength:string,evidence:array<struct<url:string,quote:string>>>>",
    "types": "array<struct<type:string,strength:string>>",
    "locations": "array<struct<address:string,postcode:string,city:string,province:string>>",
    "areas": "array<struct<scope:string,value:string>>",
    "kvk": "string", "stated_kvk": "string", "stated_on": "string",
    "sources": "array<struct<url:string,checked_at:string>>",
    "changes": "array<struct<field:string,previous:string,current:string,at:string>>",
}
Same = Callable[[Column, Column], Column]


def added(old: Column, new: Column, same: Same) -> Column:
    """``old`` and the entries of ``new`` that neither it nor an earlier entry of ``new`` has."""
    fresh = F.filter(new, lambda n, i: ~F.exists(old, lambda o: same(o, n)) & ~F.exists(F.slice(new, F.lit(1), i), lambda e: same(e, n)))
    return F.concat(old, fresh)


def changed_in_place(old: Column, new: Column, same: Same, take: Callable[[Column, Column], Column]) -> Column:
    """Each entry of ``old`` as ``take`` makes it from itself and the first entry of ``new`` that is the same."""
    partner = lambda o: F.get(F.filter(new, lambda n: same(o, n)), F.lit(0))
    return F.transform(old, lambda o: F.when(F.exists(new, lambda n: same(o, n)), take(o, partner(o))).otherwise(o))


def _activity_key(entry: Column, what: str) -> Column:
    """What activities are the same by: ``concept`` or, where a new one has none, ``label``, each of a kind, related or not."""
    return F.struct(entry["kind"].alias("kind"), F.coalesce(entry["related"], F.lit(False)).alias("related"), F.lit(what).alias("what"), entry[what].alias("value"))


def _merge_activity(o: Column, n: Column) -> Column:
    by_url: Same = lambda a, b: a["url"].eqNullSafe(b["url"])
    again = F.forall(o["evidence"], lambda e: F.exists(n["evidence"], lambda q: by_url(e, q)))
    strength = F.when((n["strength"] == "strong") | again, n["strength"]).otherwise(o["strength"])
    return F.struct(
        o["kind"].alias("kind"), o["concept"].alias("concept"), o["label"].alias("label"), o["related"].alias("related"),
        strength.alias("strength"), F.slice(added(o["evidence"], n["evidence"], by_url), 1, EVIDENCE).alias("evidence"),
    )


def merge_activities(stored: DataFrame, incoming: DataFrame, by: str) -> DataFrame:
    """(``by``, merged): activities of both, the stored ones first. Strong evidence always counts; weak replaces the stored judgement only
    if all pages that it rested on were read again. Evidence of further pages is added, up to five pieces in all.

    Activities meet by joins on their keys, so a company with many costs no more than their number. A stored one answers to
    its concept and to its label and takes the first new one that asks for either; of new ones that are the same the first counts.
    """
    entry, at = F.col("entry"), F.col("at")
    listed = lambda df: df.select(by, F.posexplode("activities").alias("at", "entry"))
    # an activity answers to its label, and to its concept if it has one; a new one asks for its concept, else for its label
    names = F.array(_activity_key(entry, "label"), F.when(entry["concept"].isNotNull(), _activity_key(entry, "concept")))
    answers = lambda df: df.select("*", F.explode(names).alias("key")).where("key is not null")
    asks = F.when(entry["concept"].isNotNull(), _activity_key(entry, "concept")).otherwise(_activity_key(entry, "label"))
    old, new = listed(stored), listed(incoming)
    asked = answers(new).withColumn("asking", F.col("key") == asks).groupBy(by, "key").agg(
        F.min("at").alias("answer"), F.min(F.when(F.col("asking"), at)).alias("first"), F.min_by("entry", F.when(F.col("asking"), at)).alias("found")
    ).where(F.col("first").isNotNull())
    known = answers(old)
    met = known.join(asked, [by, "key"]).groupBy(by, "at").agg(F.min_by("found", "first").alias("found"))
    kept = old.join(met, [by, "at"], "left").select(by, F.lit(0).alias("turn"), "at", F.when(F.col("found").isNull(), entry).otherwise(_merge_activity(entry, F.col("found"))).alias("entry"))
    fresh = asked.where("first = answer").join(known.select(by, "key").distinct(), [by, "key"], "left_anti").select(by, F.lit(1).alias("turn"), F.col("first").alias("at"), F.col("found").alias("entry"))
    return kept.unionByName(fresh).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "at", "entry"))), lambda x: x["entry"]).alias("merged"))


def _same_place(a: Column, b: Column) -> Column:
    return F.coalesce(a["postcode"], a["city"]).eqNullSafe(F.coalesce(b["postcode"], b["city"]))


def update_profiles(stored: DataFrame, incoming: DataFrame, by: str = "company") -> DataFrame:
    """Profiles after a run, with ``changed`` and ``is_new``; both tables have ``by``, the columns of ``PROFILE`` and checked_at.

    A single value that a run found replaces the stored one, whose former value goes to ``changes``, the last 50. Types only
    become stronger. A place that is read with its province replaces the same one without. Only pages that were read
    again have a new date of check. The registration that is known stays, the one stated on a page is the latest. A
    company that no run found again stays as it is, a new one comes as it was found. ``changed`` is false where a
    run says nothing new; dates of check are no news, so the same run twice changes nothing. Missing lists are empty.
    """
    whole = lambda df: df.select(by, "checked_at", *((F.coalesce(F.col(c), F.array().cast(t)) if t.startswith("array") else F.col(c)).alias(c) for c, t in PROFILE.items()))
    s, n = whole(stored), whole(incoming)
    m = merge_activities(s, n, by).alias("m")
    s, n = s.alias("s"), n.alias("n")
    old, new = (lambda c: F.col(f"s.{c}")), (lambda c: F.col(f"n.{c}"))
    at = new("checked_at")
    differs = lambda c: new(c).isNotNull() & old(c).isNotNull() & (new(c) != old(c))
    note = lambda c, name: F.when(differs(c), F.struct(F.lit(name).alias("field"), old(c).alias("previous"), new(c).alias("current"), at.alias("at")))
    notes = F.array_compact(F.array(*(note(c, c) for c in SINGLE), note("stated_kvk", "registration")))
    changes = F.concat(old("changes"), notes)
    by_type: Same = lambda a, b: a["type"].eqNullSafe(b["type"])
    by_url: Same = lambda a, b: a["url"].eqNullSafe(b["url"])
    by_area: Same = lambda a, b: a.eqNullSafe(b)
    stronger = lambda o, x: F.when((o["strength"] == "weak") & (x["strength"] == "strong"), x).otherwise(o)
    placed = lambda o, x: F.when(o["province"].isNull() & x["province"].isNotNull(), x).otherwise(o)
    seen = lambda o, x: F.struct(o["url"].alias("url"), at.alias("checked_at"))
    merged = {c: F.coalesce(new(c), old(c)) for c in SINGLE} | {
        "trade_names": F.slice(F.array_distinct(F.concat(old("trade_names"), new("trade_names"))), 1, TRADE_NAMES),
        "activities": F.coalesce(F.col("m.merged"), F.array().cast(PROFILE["activities"])),
        "types": added(changed_in_place(old("types"), new("types"), by_type, stronger), new("types"), by_type),
        "locations": F.slice(added(changed_in_place(old("locations"), new("locations"), _same_place, placed), new("locations"), _same_place), 1, LOCATIONS),
        "areas": F.slice(added(old("areas"), new("areas"), by_area), 1, AREAS),
        "kvk": F.coalesce(old("kvk"), new("kvk")),
        "stated_kvk": F.coalesce(new("stated_kvk"), old("stated_kvk")),
        "stated_on": F.when(new("stated_kvk").isNotNull(), new("stated_on")).otherwise(old("stated_on")),
        "sources": F.slice(added(changed_in_place(old("sources"), new("sources"), by_url, seen), new("sources"), by_url), 1, SOURCES),
        "changes": F.slice(changes, F.greatest(F.size(changes) - CHANGES + 1, F.lit(1)), F.lit(CHANGES)),
    }
    both, had, found = old(by).isNotNull() & new(by).isNotNull(), old(by).isNotNull(), new(by).isNotNull()
    lasting = lambda c, v: F.transform(v, lambda x: x["url"]) if c == "sources" else v
    same = F.lit(True)
    for c, v in merged.items():
        same = same & lasting(c, v).eqNullSafe(lasting(c, old(c)))
    return s.join(n, old(by) == new(by), "full").join(m, F.coalesce(old(by), new(by)) == F.col(f"m.{by}"), "left").select(
        F.coalesce(old(by), new(by)).alias(by),
        F.coalesce(new("checked_at"), old("checked_at")).alias("checked_at"),
        *(F.when(both, v).when(had, old(c)).otherwise(new(c)).alias(c) for c, v in merged.items()),
        (F.when(both, ~same).otherwise(found)).alias("changed"),
        (~had).alias("is_new"),
    )
