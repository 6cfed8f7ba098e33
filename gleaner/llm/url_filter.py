"""URL filters: fixed host and path rules, then gradient-boosted trees on lexical features.

Features are native column expressions: lengths, depth, digit ratio, entropy,
parameter counts, hyphens, and how often the host's suffix was blocked among all
labelled URLs. The trees are trained from at most ``SAMPLE_ROWS`` labelled URLs,
weighted so that each label has the share that it has among all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.storage import materialize

from .common import ascii_lower, let, table

SAMPLE_ROWS = 3000
#: Each split chooses among part of the features, so that none carries the verdict alone.
TREES, DEPTH, LEAST_ROWS, FEATURE_SUBSET = 10, 4, 5, "0.6"
#: A page is junk if over this share of its words are symbols or end in them, or over this share of its text is in links.
JUNK_SYMBOLS, JUNK_LINKS = 0.2, 0.6
#: Fixed values of the contract: verdict, host and path of each rule.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Words between hyphens or dots of a host that label a URL as unwanted for training.
UNWANTED = "ad ads adult bet bonus casino cheap cialis clickbait crack dating deals escort free gambling loan loans lottery nude pharma pills poker porn replica sex slots spam torrent viagra warez win xxx".split()
FEATURES = [
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy", "parameters", "hyphens", "host_hyphens", "punctuation", "https", "host_words", "host_mean_word", "host_longest_word", "host_vowels", "suffix_rate",
]


def host_path(url: Column) -> Column:
    """Struct of host and path; both empty for null and for a URL without ``://``."""

    def of_url(u: Column) -> Column:
        at = F.locate("://", u)
        rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))

        def of_rest(r: Column) -> Column:
            host = F.regexp_extract(r, r"(?s)^[^/?#]*", 0)
            path = F.regexp_extract(r, r"(?s)^[^/?#]*([^?#]*)", 1)
            return F.struct(ascii_lower(host).alias("host"), path.alias("path"))

        return let(rest, of_rest)

    return let(F.coalesce(url, F.lit("")), of_url)


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] | None = None) -> Column:
    """Struct of rule and verdict of the longest rule that fits; null if none does."""
    ordered = sorted(RULES if rules is None else rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1:]))
    out = None
    for verdict, h, p in ordered:
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def _entropy(text: Column) -> Column:
    """Bits a character."""

    def of_text(t: Column) -> Column:
        n = F.length(t)
        each = F.transform(
            F.array_distinct(F.split(t, "")), lambda c: (n - F.length(F.replace(t, c, F.lit("")))) / n
        )
        return F.aggregate(each, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)))

    return F.when(F.length(text) > 0, let(text, of_text)).otherwise(F.lit(0.0))


def _count(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]", ""))


def _ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def with_features(urls: DataFrame) -> DataFrame:
    """Adds the features, but for the suffix's, to rows of (url, host, path)."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    words = F.split(host, r"[.\-]+")
    return urls.withColumns(
        {
            "url_length": F.length(url).cast("double"),
            "host_length": F.length(host).cast("double"),
            "path_length": F.length(path).cast("double"),
            "depth": _count(path, "/").cast("double"),
            "labels": _count(host, ".").cast("double"),
            "digit_ratio": _ratio(_count(url, "0-9"), F.length(url)),
            "host_digit_ratio": _ratio(_count(host, "0-9"), F.length(host)),
            "entropy": _entropy(url),
            "host_entropy": _entropy(host),
            "parameters": F.when(F.contains(url, F.lit("?")), _count(url, "&") + 1).otherwise(F.lit(0)).cast("double"),
            "hyphens": _count(url, "\\-").cast("double"),
            "host_hyphens": _count(host, "\\-").cast("double"),
            "punctuation": _ratio(_count(url, "%=&_~+;,"), F.length(url)),
            "https": F.startswith(url, F.lit("https:")).cast("double"),
            "host_words": F.size(words).cast("double"),
            "host_mean_word": _ratio(F.length(F.array_join(words, "")), F.size(words)),
            "host_longest_word": F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0)).cast("double"),
            "host_vowels": _ratio(_count(host, "aeiouy"), F.length(host)),
            "suffix": F.substring_index(host, ".", -1),
        }
    )


def junk_page(html: Column) -> Column:
    """True if the page's text is mostly links, or strewn with symbols; false for null and for a page without text."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")

    def of_body(b: Column) -> Column:
        said = lambda x: F.btrim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", " "), "&amp;", "&"))
        links = said(F.array_join(F.regexp_extract_all(b, F.lit(r"(?is)<a\b[^>]*>(.*?)</a\s*>"), 1), " "))

        def of_text(t: Column) -> Column:
            words = F.length(F.regexp_replace(t, r"[^ ]+ *", "x"))
            marked = F.length(F.regexp_replace(F.regexp_replace(t, r"[^ ]*[#*$%&|]+(?= |$)", "\u0001"), "[^\u0001]", ""))
            return F.coalesce(
                (marked > JUNK_SYMBOLS * F.greatest(words, F.lit(1))) | (F.length(links) > JUNK_LINKS * F.greatest(F.length(t), F.lit(1))),
                F.lit(False),
            )

        return let(said(b), of_text)

    return let(body, of_body)


def labelled_urls(pages: DataFrame) -> DataFrame:
    """(url, label) of all pages (url, html): label 1 for the URLs of an unwanted host, else 0.

    A host is unwanted if a word of ``UNWANTED`` stands alone in it, or if most of its pages are junk (of at
    least three). The trees see neither words nor pages, only lexical features.
    """
    known = pages.where("url is not null").select("url", host_path(F.col("url"))["host"].alias("host"), junk_page(F.col("html")).alias("junk"))
    by_url = materialize(
        known.groupBy("url", "host").agg(F.count(F.lit(1)).alias("n"), F.count_if("junk").alias("junk")), "labelled"
    )
    hosts = by_url.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("junk").alias("host_junk"))
    named = F.arrays_overlap(F.split(F.col("host"), r"[.\-]"), F.array(*(F.lit(w) for w in UNWANTED)))
    bad = named | (2 * F.col("host_junk") > F.col("host_n") + 2)
    return by_url.join(hosts, "host").select("url", bad.cast("double").alias("label"))


class UrlModel:
    """Trees with the suffix statistics that their features need; ``trees`` is None if only one label was seen.

    ``suffixes`` is (suffix, suffix_rate) of every suffix with a label; other suffixes have ``rate``.
    """

    def __init__(self, trees: GBTClassificationModel | None, suffixes: DataFrame, constant: str, rate: float) -> None:
        self.trees, self.suffixes, self.constant, self.rate = trees, suffixes, constant, rate

    def with_suffix_rate(self, rows: DataFrame) -> DataFrame:
        """Adds ``suffix_rate`` to rows with a suffix; a join whose skewed partitions adaptive execution may split."""
        return rows.join(self.suffixes, "suffix", "left").fillna(self.rate, ["suffix_rate"])


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> UrlModel:
    """Train on (url, label), label 1 for block.

    A URL counts once for each label it has. Half of the bounded sample, as far as there are enough, is of
    either label; weights give the labels their shares among all URLs, so a score of 0.5 means the same at
    every size. Suffix statistics are counted over all URLs.
    """
    parts = labelled.where("label is not null").dropDuplicates(["url", "label"]).withColumn("hp", host_path(F.col("url")))
    parts = parts.select("url", "label", "hp.*")
    by_suffix = materialize(
        parts.groupBy(F.substring_index("host", ".", -1).alias("suffix")).agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("bad")
        ),
        "suffixes",
    )
    n, bad = by_suffix.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0.0))).first()
    rate = bad / n if n else 0.0
    suffixes = by_suffix.select("suffix", ((F.col("bad") + 10 * rate) / (F.col("n") + 10)).alias("suffix_rate"))
    model = UrlModel(None, suffixes, "block" if n and bad == n else "allow", rate)
    if 0 < bad < n:
        order = [F.xxhash64("url"), "url"]
        share = {1.0: rate, 0.0: 1 - rate}
        picked = reduce(
            DataFrame.unionByName,
            [parts.where(F.col("label") == v).orderBy(*order).limit(sample_rows // 2) for v in share],
        )
        sample = materialize(with_features(picked).coalesce(1), "urls")
        taken = dict(sample.groupBy("label").count().collect())
        weight = F.lit(0.0)
        for v, s in share.items():  # of mean one
            weight = F.when(F.col("label") == v, s * sum(taken.values()) / taken[v]).otherwise(weight)
        points = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(
            model.with_suffix_rate(sample).coalesce(1).orderBy(*order, "label")
        )
        model.trees = GBTClassifier(
            maxIter=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAST_ROWS, featureSubsetStrategy=FEATURE_SUBSET, seed=42,
            featuresCol="features", labelCol="label", weightCol="weight",
        ).fit(points.select("features", "label", weight.alias("weight")))
    return model


def judge(urls: DataFrame, model: UrlModel, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for rows of (page_id, url).

    The longest rule that fits decides, else the trees (score: their probability
    of block; a tie at one half is allowed). Null URLs and URLs without ``://``
    have no host and fit no rule. Repeated rows give repeated results, an empty
    table an empty one; very long URLs are read whole; further columns are not read.
    """
    parts = urls.select("page_id", "url", host_path(F.col("url")).alias("hp")).select("page_id", "url", "hp.*")
    known = parts.withColumn("fit", match_rule(F.col("host"), F.col("path"), rules))
    if model.trees is None:
        scored = known.withColumn("score", F.lit(1.0 if model.constant == "block" else 0.0))
    else:
        points = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(
            model.with_suffix_rate(with_features(known))
        )
        scored = model.trees.transform(points).withColumn("score", vector_to_array("probability")[1])
    own = F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), own).alias("verdict"), "score"
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page, one row for each row of ``pages``."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages.select("page_id", "url"), fit(labelled_urls(pages.select("url", "html"))))
