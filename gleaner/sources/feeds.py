"""Sitemaps, robots rules and addresses of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_LOCATIONS = 50_000


def sitemap_locations(files: DataFrame, origin: str, body: str) -> DataFrame:
    """(origin, kind, ord, location) of the sitemaps in ``body``; a file with a DOCTYPE or ENTITY gives nothing."""
    safe = files.where(~F.rlike(body, F.lit("(?i)<!(?:DOCTYPE|ENTITY)")))
    kind = F.when(F.rlike(body, F.lit("(?i)<sitemapindex")), F.lit("index")).otherwise(F.lit("pages"))
    found = F.regexp_extract_all(body, F.lit(r"(?is)<loc>\s*([^<]*?)\s*</loc>"), F.lit(1))
    each = safe.select(origin, kind.alias("kind"), F.posexplode(F.slice(found, 1, MOST_LOCATIONS)).alias("ord", "raw"))
    clean = F.replace(F.col("raw"), F.lit("&amp;"), F.lit("&"))
    return each.select(origin, "kind", "ord", clean.alias("location"))


def robots_rules(origins: DataFrame, origin: str, status: str, body: str) -> DataFrame:
    """(origin, rules): what each origin's robots file says to every agent, read once an origin.

    Only 200 is read; 404 and 410 allow all, others nothing. A rule is a struct of length, allow and a regular expression.
    """
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    fields = F.transform(
        F.filter(lines, lambda x: F.contains(x, F.lit(":"))),
        lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")),
    )
    rule = "struct<length:int,allow:boolean,pattern:string>"
    state = F.struct(F.lit(False).alias("naming"), F.lit(False).alias("ours"), F.array().cast(f"array<{rule}>").alias("rules"))

    def step(a: Column, f: Column) -> Column:
        agent, path = f["name"] == "user-agent", f["name"].isin("allow", "disallow")
        # agents in a row share the rules that follow
        ours = F.when(agent, (a["naming"] & a["ours"]) | (f["value"] == "*")).otherwise(a["ours"])
        quoted = F.regexp_replace(f["value"], r"([.+?^{}()|\[\]\\])", r"\\$1")
        pattern = F.concat(F.lit("^"), F.regexp_replace(F.replace(quoted, F.lit("*"), F.lit(".*")), r"\$(?!$)", r"\\\$"))
        made = F.struct(F.length(f["value"]).alias("length"), (f["name"] == "allow").alias("allow"), pattern.alias("pattern"))
        counts = path & a["ours"] & (f["value"] != "")
        return F.struct(agent.alias("naming"), ours.alias("ours"), F.when(counts, F.array_append(a["rules"], made)).otherwise(a["rules"]).alias("rules"))

    read = F.aggregate(fields, state, step)["rules"]
    nothing = F.array(F.struct(F.lit(1).alias("length"), F.lit(False).alias("allow"), F.lit("^/").alias("pattern")))
    none = F.array().cast(f"array<{rule}>")
    rules = F.when(F.col(status) == 200, read).when(F.col(status).isin(404, 410), none).otherwise(nothing)
    return origins.select(origin, rules.alias("rules"))


def robots_allow(rules: Column, path: Column) -> Column:
    """Whether rules let a path (with its query) be fetched: the longest that fits decides, allow before disallow."""
    fits = F.filter(rules, lambda r: F.rlike(path, r["pattern"]))
    return F.coalesce(F.array_max(F.transform(fits, lambda r: F.struct(r["length"], r["allow"])))["allow"], F.lit(True))


#: Networks of four-part addresses that are not public, as first address and number of leading bits.
RESERVED = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.88.99.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
]
#: Beginnings of long addresses that are not public: loopback, local, multicast, tunnels and examples.
RESERVED_LONG = r"^(?:::1?$|::ffff:|f[cd]|fe[89ab]|ff|0*:|64:ff9b:|100::|2001:0?0{0,3}:|2001:db8|2001:1[0-9a-f]:|2002:)"


def _number(address: str) -> int:
    a, b, c, d = map(int, address.split("."))
    return (a << 24) + (b << 16) + (c << 8) + d


def _public_four(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\."), lambda x: x.try_cast("bigint"))
    good = F.rlike(text, F.lit(r"^\d{1,3}(?:\.\d{1,3}){3}$")) & F.forall(parts, lambda p: p <= 255)
    n = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a * 256 + p)
    held = F.lit(False)
    for first, bits in RESERVED:
        held = held | (F.shiftright(n, 32 - bits) == _number(first) >> (32 - bits))
    return good & ~held


def public_address(address: Column) -> Column:
    """True for a global unicast address; false for anything else, also for what is no address."""
    text = F.lower(F.trim(F.coalesce(address, F.lit(""))))
    long = F.rlike(text, F.lit(r"^[0-9a-f:]+$")) & F.rlike(text, F.lit(":.*:")) & ~F.rlike(text, F.lit(":::|::.*::")) & ~F.rlike(text, F.lit(RESERVED_LONG))
    mapped = F.regexp_extract(text, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    whole = F.contains(text, F.lit("::")) | (F.size(F.split(text, ":")) == 8)
    return F.when(mapped != "", _public_four(mapped)).when(F.contains(text, F.lit(":")), long & whole).otherwise(F.coalesce(_public_four(text), F.lit(False)))


def failure_kind(status: Column, message: Column) -> Column:
    """Class of a failed request."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(status == 429, F.lit("rate_limited"))
        .when(status.isin(401, 403), F.lit("blocked"))
        .when(F.rlike(text, F.lit("time.?out|timed out|abort")), F.lit("timeout"))
        .when((status >= 500) & (status != 503), F.lit("transient"))
        .when(status >= 400, F.lit("http_error"))
        .otherwise(F.lit("network"))
    )
