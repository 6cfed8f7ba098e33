"""Matching of organisations and of criteria with evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .classes import row_pairs

#: Words that don't tell organisations apart.
NAME_STOPWORDS = [
    "de", "het", "een", "van", "der", "den", "en", "the", "of", "and", "bv", "nv", "b", "v", "n",
    "gemeente", "provincie", "waterschap", "stichting", "ministerie", "vereniging", "www",
]
#: Of the shorter name's words, the share that the longer one must have.
LEAST_SHARE = 0.6
STATUS_RANK = {"insufficient": 0, "possible": 1, "confirmed": 2}


def name_tokens(folded: Column) -> Column:
    """Significant words, of three characters or more, of a name without accents in lower case; empty for null."""
    words = F.split(F.coalesce(folded, F.lit("")), "[^a-z0-9]+")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(NAME_STOPWORDS))


def tokens_match(a: Column, b: Column) -> Column:
    """At least 60 % of the shorter list's words, repeats counted, are in the longer one."""
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    share = F.size(F.filter(short, lambda w: F.array_contains(long, w))) / F.size(short)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(False)).otherwise(share >= LEAST_SHARE)


def similar_names(names: DataFrame, block: list[str]) -> DataFrame:
    """(a, b), a < b: rows of (ord, ``block``, tokens) of one block whose names match as in ``tokens_match``.

    Names with the same words in the same order are one class, and classes are compared by a set-similarity join. The words
    of a name are put in order of how many classes hold them, rarest first. A shorter name that shares enough words with a
    longer one shares one of its first ``n - least + 1``, so only classes that meet in such a word and whose lengths allow it
    are compared. Of two of one length either is the shorter one, for rows where it comes first.
    """
    c = F.col
    sized = names.where(F.size("tokens") > 0).select("ord", *block, "tokens")
    classes = sized.groupBy(*block, "tokens").agg(F.min("ord").alias("rep"), F.count(F.lit(1)).alias("rows")).withColumn("n", F.size("tokens"))
    # null blocks meet nothing, as in SQL
    members = sized.join(classes.select(*block, "tokens", "rep"), [*block, "tokens"]).select("ord", "rep")
    words = classes.select("rep", *block, "n", F.explode("tokens").alias("word"))
    holders = words.groupBy("word").agg(F.count_distinct("rep").alias("classes"))
    ordered = words.join(holders, "word").withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy("classes", "word")))
    least = F.ceil(c("n") * LEAST_SHARE - 1e-9)
    first = ordered.where(c("place") <= c("n") - least + 1).select(c("rep").alias("x"), c("n").alias("short_n"), "word", *block).distinct()
    every = words.select(c("rep").alias("y"), c("n").alias("long_n"), "word", *block).distinct()
    met = first.join(every, [*block, "word"]).where((c("short_n") <= c("long_n")) & (c("x") != c("y"))).select("x", "y", (c("short_n") == c("long_n")).alias("in_order")).distinct()
    tokens = classes.select(c("rep").alias("id"), "tokens")
    both = met.join(tokens.select(c("id").alias("x"), c("tokens").alias("s")), "x").join(tokens.select(c("id").alias("y"), c("tokens").alias("l")), "y")
    same = classes.where("rows > 1").select(c("rep").alias("x"), c("rep").alias("y"), F.lit(False).alias("in_order"))
    return row_pairs(members, both.where(tokens_match(c("s"), c("l"))).select("x", "y", "in_order").unionByName(same))


def host_names_publisher(host: Column, tokens: Column) -> Column:
    """All words of a publisher are inside the site's own label, which has four characters or more."""
    labels = F.split(F.regexp_replace(F.lower(host), r"^www\.", ""), r"\.")
    label = F.when(F.size(labels) > 1, F.get(labels, F.size(labels) - 2)).otherwise(F.get(labels, F.lit(0)))
    compact = F.regexp_replace(label, "[^a-z0-9]", "")
    return (F.size(tokens) > 0) & (F.length(compact) >= 4) & F.forall(tokens, lambda t: F.contains(compact, t))


def page_role(authority: Column, publisher: Column, site_name: Column, host: Column, platform: Column, first_person: Column) -> Column:
    """Struct of role and confidence of a page's site: official, aggregator or unknown.

    Names come folded; ``platform`` and ``first_person`` are booleans on its texts.
    """
    a, p, s = name_tokens(authority), name_tokens(publisher), name_tokens(site_name)
    stated = authority.isNotNull() & publisher.isNotNull()
    same = stated & tokens_match(a, p)
    service = F.rlike(F.concat_ws(" ", publisher, site_name), F.lit("tender|aanbested|procurement|opdrachten"))
    against = F.when(stated & ~same, 2).otherwise(0) + F.when(platform, 2).otherwise(0) + F.when(service, 2).otherwise(0)
    own_name = host_names_publisher(host, p) | host_names_publisher(host, s)
    plus = F.when(own_name, 1).otherwise(0) + F.when(first_person, 1).otherwise(0)
    official = F.when(same, 3).otherwise(0) + F.when(against == 0, plus).otherwise(0)
    role = (
        F.when((against >= 2) & (against > official), F.lit("aggregator"))
        .when((official >= 2) & (against == 0), F.lit("official_organization_site"))
        .otherwise(F.lit("unknown_web_source"))
    )
    confidence = (
        F.when(role == "aggregator", F.when(against >= 4, F.lit("high")).otherwise(F.lit("medium")))
        .when(role == "official_organization_site", F.when(official >= 3, F.lit("high")).otherwise(F.lit("medium")))
        .otherwise(F.lit("low"))
    )
    return F.struct(role.alias("role"), confidence.alias("confidence"))


def host_role(pages: DataFrame) -> DataFrame:
    """Role of each host from rows of (host, role, confidence, authority_key).

    Three different authorities make an aggregator; else any aggregator vote wins, then any official one.
    """
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    best = lambda r: F.min(F.when(F.col("role") == r, rank))
    names = F.countDistinct(F.when(F.col("authority_key") != "", F.col("authority_key")))
    votes = pages.groupBy("host").agg(names.alias("authorities"), best("aggregator").alias("ag"), best("official_organization_site").alias("of"))
    say = lambda c: F.when(c == 0, F.lit("high")).when(c == 1, F.lit("medium")).otherwise(F.lit("low"))
    many = F.col("authorities") >= 3
    return votes.select(
        "host",
        "authorities",
        F.when(many | F.col("ag").isNotNull(), F.lit("aggregator")).when(F.col("of").isNotNull(), F.lit("official_organization_site")).otherwise(F.lit("unknown_web_source")).alias("role"),
        F.when(many, F.lit("high")).when(F.col("ag").isNotNull(), say(F.col("ag"))).when(F.col("of").isNotNull(), say(F.col("of"))).otherwise(F.lit("low")).alias("confidence"),
    )


def activity_strength(hits: DataFrame, keys: list[str]) -> DataFrame:
    """strong if a title or heading names the activity or two pages do, else weak; with mention and page counts.

    ``hits``: the keys, page, place (title, heading or text) and mentions.
    """
    named = F.coalesce(F.bool_or(F.col("place").isin("title", "heading")), F.lit(False))
    return hits.groupBy(*keys).agg(
        F.sum("mentions").cast("bigint").alias("mentions"),
        F.countDistinct("page").alias("pages"),
        F.when(named | (F.countDistinct("page") >= 2), F.lit("strong")).otherwise(F.lit("weak")).alias("strength"),
    )


def criteria_status(matches: DataFrame, key: str, subjects: list[str]) -> DataFrame:
    """Verdict of each record from rows of (key, kind, status): best of a kind, then all kinds together.

    Every kind confirmed: confirmed. All subject kinds insufficient: insufficient. Any kind above: possible.
    """
    rank = F.when(F.col("status") == "confirmed", 2).when(F.col("status") == "possible", 1).otherwise(0)
    kinds = matches.groupBy(key, "kind").agg(F.max(rank).alias("rank"))
    is_subject = F.col("kind").isin(subjects)
    no_subject = F.coalesce(F.bool_and(F.when(is_subject, F.col("rank") == 0)), F.lit(False))
    return kinds.groupBy(key).agg(
        F.count(F.lit(1)).alias("kinds"),
        F.when(F.bool_and(F.col("rank") == 2), F.lit("confirmed"))
        .when(no_subject, F.lit("insufficient"))
        .when(F.bool_or(F.col("rank") > 0), F.lit("possible"))
        .otherwise(F.lit("insufficient"))
        .alias("status"),
    )
