"""Terms of a vocabulary in texts, by joins: any number of texts against any number of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import STOPWORDS, normalize_words, words_of

#: Words of a term at most; letters from which a plural ending and, later, any tail of a compound is allowed.
MOST_WORDS, PLURAL, COMPOUND = 4, 5, 8
#: Words after which a request names what it does not want.
EXCLUDING = "geen niet zonder behalve exclusief except excluding without no".split()


def _grams(words: Column) -> Column:
    """Structs of start, size and text of the runs of one to ``MOST_WORDS`` words."""
    none = F.array().cast("array<struct<start:int,size:int,gram:string>>")

    def of_size(n: int) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.size(words) - n),
            lambda i: F.struct(i.alias("start"), F.lit(n).alias("size"), F.array_join(F.slice(words, i + 1, F.lit(n)), " ").alias("gram")),
        )
        return F.when(F.size(words) >= n, runs).otherwise(none)

    return F.concat(*(of_size(n) for n in range(1, MOST_WORDS + 1)))


def scan_vocabulary(texts: DataFrame, key: str, text: Column, terms: DataFrame) -> DataFrame:
    """(key, words, spans): the terms (term, concept, kind) that stand in each text, longest first, none over another.

    A span is start, size, term and its concepts. A term of five letters may have a plural ending, one of eight any tail.
    Texts without a term have no spans; a null text has no words.
    """
    known = terms.select(normalize_words(F.col("term")).alias("term"), F.struct("kind", "concept").alias("means")).groupBy("term").agg(F.array_sort(F.collect_set("means")).alias("concepts"))
    read = texts.select(F.col(key).alias("text_key"), words_of(text).alias("words"))
    grams = read.select("text_key", F.inline(_grams(F.col("words"))))
    stems = F.array_distinct(F.array(F.col("gram"), *(F.when(F.endswith("gram", F.lit(e)), F.expr(f"left(gram, length(gram) - {len(e)})")) for e in ("en", "es", "s", "n"))))
    exact = grams.withColumn("term", F.explode(F.array_compact(stems))).join(known, "term").where((F.col("gram") == F.col("term")) | (F.length("term") >= PLURAL))
    long = known.where(F.length("term") >= COMPOUND).withColumn("head", F.left("term", F.lit(COMPOUND)))
    tailed = grams.withColumn("head", F.left("gram", F.lit(COMPOUND))).join(long, "head").where(F.startswith("gram", F.col("term")) & ~F.contains(F.expr("substr(gram, length(term) + 1)"), F.lit(" ")))
    columns = ["text_key", "start", "size", "term", "concepts"]
    met = exact.select(*columns).unionByName(tailed.select(*columns)).distinct()
    span = F.struct((-F.length("term")).alias("rank"), "start", "size", "term", "concepts")
    # a text's spans are at most so many as it has runs of words
    listed = met.groupBy("text_key").agg(F.array_sort(F.collect_set(span)).alias("all"))

    def take(kept: Column, s: Column) -> Column:
        clash = F.exists(kept, lambda k: (k["start"] < s["start"] + s["size"]) & (s["start"] < k["start"] + k["size"]))
        return F.when(clash, kept).otherwise(F.array_append(kept, s))

    none = F.expr("cast(array() as array<struct<rank:int,start:int,size:int,term:string,concepts:array<struct<kind:string,concept:string>>>>)")
    spans = F.array_sort(F.transform(F.aggregate(F.coalesce("all", none), none, take), lambda s: F.struct(s["start"], s["size"], s["term"], s["concepts"])))
    return read.join(listed, "text_key", "left").select(F.col("text_key").alias(key), "words", spans.alias("spans"))


def interpret(requests: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, criteria, exclusions, unrecognized): what a request in plain words asks for.

    ``criteria``: kind and concept of every term, in order; what follows a word of exclusion up to a stop is no
    criterion. Words of four letters or more that no term covers and that say something are listed, at most eight.
    """
    cue = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(EXCLUDING)})\s+([^,.;]+)"
    without = F.regexp_replace(F.col(text), cue, " . ")
    found = scan_vocabulary(requests, key, without, terms)
    said = requests.select(F.col(key).alias("asked"), F.transform(F.regexp_extract_all(text, F.lit(cue), F.lit(1)), lambda x: F.trim(x)).alias("exclusions"))
    covered = lambda i: F.exists("spans", lambda s: (s["start"] <= i) & (i < s["start"] + s["size"]))
    words = F.filter(F.transform("words", lambda w, i: F.when(~covered(i) & (F.length(w) >= 4) & ~F.rlike(w, F.lit(r"^\d+$")) & ~w.isin(STOPWORDS), w)), lambda w: w.isNotNull())
    criteria = F.array_distinct(F.flatten(F.transform("spans", lambda s: s["concepts"])))
    return found.join(said, F.col(key) == F.col("asked")).select(key, criteria.alias("criteria"), "exclusions", F.slice(F.array_distinct(words), 1, 8).alias("unrecognized"))
