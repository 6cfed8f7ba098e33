"""URL functions as column expressions over absolute URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
#: Parameters that follow visitors, for crawling and for search results.
CRAWL_TRACKING = r"(?i)^(utm_.+|fbclid|gclid)$"
SEARCH_TRACKING = r"(?i)^(utm_.+|fbclid|gclid|msclkid|ref|referrer)$"
BINARY = r"(?i)\.(?:pdf|jpe?g|png|gif|webp|svg|ico|zip|gz|mp[34]|avi|woff2?|ttf|css|js|xml|txt)$"
#: Public suffixes of two labels.
TWO_LABEL_SUFFIXES = "co.uk org.uk ac.uk gov.uk com.au net.au co.nz co.za com.br com.tr co.jp com.cn com.mx co.in".split()


#: The parts of a reference, each with its mark: scheme, authority, path, query, fragment.
_REFERENCE = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments, folded from its first segment on; no more is left than there is."""
    none = F.array().cast("array<string>")

    def fold(segments: Column) -> Column:
        def step(kept: Column, i: Column) -> Column:
            segment, last = F.get(segments, i), i == F.size(segments) - 1
            up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
            # a dot at the end leaves the folder's slash
            open_end = lambda rest: F.when(last, F.array_append(rest, F.lit(""))).otherwise(rest)
            return F.when(segment == ".", open_end(kept)).when(segment == "..", open_end(up)).otherwise(F.array_append(kept, segment))

        rooted = F.get(segments, F.lit(0)) == ""
        kept = F.aggregate(F.sequence(rooted.cast("int"), F.size(segments) - 1), none, step)
        return F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))

    return F.when(F.contains(path, F.lit(".")), once(F.split(path, "/"), fold)).otherwise(path)


def resolve(base: Column, reference: Column) -> Column:
    """The address that a reference means on a page of the absolute address ``base``; null without one of them.

    White space around a reference and line breaks and tabs in it do not count.
    """
    names = ("scheme", "authority", "path", "query", "fragment")
    parts = lambda url: F.struct(*(F.regexp_extract(url, _REFERENCE, i + 1).alias(n) for i, n in enumerate(names)))
    ref = F.trim(F.regexp_replace(reference, r"[\t\r\n]+", ""))

    def of_parts(x: Column) -> Column:
        b, r = x["base"], x["ref"]
        folder = F.when((b["authority"] != "") & (b["path"] == ""), F.lit("/")).otherwise(F.regexp_extract(b["path"], r"(?s)^(.*/)", 1))
        merged = F.when(F.startswith(r["path"], F.lit("/")), r["path"]).otherwise(F.concat(folder, r["path"]))
        own = (r["scheme"] != "") | (r["authority"] != "")
        stays = ~own & (r["path"] == "")
        return F.concat(
            F.when(r["scheme"] != "", r["scheme"]).otherwise(b["scheme"]),
            F.when(own, r["authority"]).otherwise(b["authority"]),
            F.when(stays, b["path"]).otherwise(without_dots(F.when(own, r["path"]).otherwise(merged))),
            F.when(stays & (r["query"] == ""), b["query"]).otherwise(r["query"]),
            r["fragment"],
        )

    return F.when(base.isNotNull() & reference.isNotNull(), once(F.struct(parts(base).alias("base"), parts(ref).alias("ref")), of_parts))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def host(url: Column) -> Column:
    """Lower case, without user, port and a closing dot."""
    name = F.regexp_replace(F.lower(authority(url)), r"^.*@|:[0-9]*$", "")
    return F.regexp_replace(name, r"\.$", "")


def port(url: Column) -> Column:
    return F.regexp_extract(authority(url), r":([0-9]+)$", 1)


def path(url: Column) -> Column:
    """The path; ``/`` if there is none."""
    p = F.regexp_extract(url, _PARTS, 3)
    return F.when(p == "", F.lit("/")).otherwise(p)


def query_parameters(url: Column) -> Column:
    """``name=value`` strings, in order."""
    q = F.regexp_replace(F.regexp_extract(url, _PARTS, 4), r"^\?", "")
    return F.filter(F.split(q, "&"), lambda x: x != "")


def parameter_names(url: Column) -> Column:
    return F.transform(query_parameters(url), lambda x: F.substring_index(x, "=", 1))


def without_www(name: Column) -> Column:
    return F.regexp_replace(name, r"^www\.", "")


def is_web(url: Column) -> Column:
    """http or https, without user information."""
    return scheme(url).isin("http", "https") & ~F.contains(authority(url), F.lit("@")) & (host(url) != "")


def in_scope(url: Column, domain: Column | str) -> Column:
    """A page of the site ``domain`` (with or without www), not a binary file."""
    return is_web(url) & (without_www(host(url)) == domain) & ~F.rlike(path(url), F.lit(BINARY))


def normalize_url(url: Column, tracking: str = CRAWL_TRACKING) -> Column:
    """Lower-case host, no fragment, no tracking parameters, the others sorted by name; null if not a web URL.

    Parameter values stay as they are written.
    """
    kept = F.filter(query_parameters(url), lambda x: ~F.rlike(F.substring_index(x, "=", 1), F.lit(tracking)))
    ranked = F.sort_array(
        F.transform(kept, lambda x, i: F.struct(F.substring_index(x, "=", 1).alias("n"), i.alias("i"), x.alias("x")))
    )
    query = F.array_join(F.transform(ranked, lambda s: s["x"]), "&")
    standard = ((scheme(url) == "http") & (port(url) == "80")) | ((scheme(url) == "https") & (port(url) == "443"))
    tail = F.when((port(url) != "") & ~standard, F.concat(F.lit(":"), port(url))).otherwise(F.lit(""))
    whole = F.concat(
        scheme(url), F.lit("://"), host(url), tail, path(url), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))
    )
    return F.when(is_web(url), whole)


def registrable_domain(name: Column) -> Column:
    """The last two labels of a host, or three after a two-label suffix; addresses and short names as they are."""
    h = F.regexp_replace(F.regexp_replace(F.lower(name), r"\.$", ""), r"^www\d?\.", "")
    last_two = F.substring_index(h, ".", -2)
    plain = (F.size(F.split(h, r"\.")) <= 2) | F.rlike(h, F.lit(r"^\d+(?:\.\d+){3}$"))
    return (
        F.when(plain, h).when(last_two.isin(TWO_LABEL_SUFFIXES), F.substring_index(h, ".", -3)).otherwise(last_two)
    )


def link_priority(where: Column, label: Column, extra: list[tuple[str, int]] = ()) -> Column:
    """Tier of a link by its folded path and label, lowest first; 10 for a link that no tier names."""
    text = F.concat_ws(" ", where, label)
    # fixed values: words of a tier and its number, in order of precedence
    tiers = [
        ("contact(?:-us|ez-nous)?", 0),
        (r"about|a[-_\s]?propos", 1),
        ("reservation|booking|reserver", 2),
        *extra,
        ("facilit(?:y|ies)|amenit(?:y|ies)|services?|voorzieningen|equipements?", 4),
        ("tarifs?|prices?|pricing|rates?|prijzen", 5),
        ("gallery|galerie|photos?|foto[s]?", 6),
        (r"(?<![a-z0-9_])faq(?![a-z0-9_])|conditions?|house[-_\s]?rules?|huisregels?|reglement", 7),
    ]
    out = F.when(F.rlike(text, F.lit(tiers[0][0])), F.lit(tiers[0][1]))
    for pattern, value in tiers[1:]:
        out = out.when(F.rlike(text, F.lit(pattern)), F.lit(value))
    return out.otherwise(F.lit(10))


_KEY = r"(?:job|vacancy|vacature|position|posting|opening|requisition)[-_]?id"
_IDENTIFIER = r"^[\p{L}\p{N}._-]{2,}$"


def job_identity(url: Column) -> Column:
    """``origin|[namespace|]type|value`` of an explicit job identifier in a URL; null if there is none.

    Query parameters come before path segments, the first match wins.
    """
    origin = F.concat(scheme(url), F.lit("://"), F.regexp_replace(F.lower(authority(url)), r"^www\.", ""))

    def good(value: Column) -> Column:
        return F.rlike(value, F.lit(_IDENTIFIER)) & F.rlike(value, F.lit(r"\d"))

    def kind(name: Column) -> Column:
        return F.regexp_replace(F.lower(name), "[-_]", "")

    parameters = F.transform(
        query_parameters(url),
        lambda x: F.struct(
            F.substring_index(x, "=", 1).alias("n"),
            F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "(?s)^[^=]*=", "")).otherwise(F.lit("")).alias("v"),
        ),
    )
    by_query = F.get(
        F.transform(
            F.filter(parameters, lambda p: F.rlike(p["n"], F.lit(f"(?i)^{_KEY}$")) & good(p["v"])),
            lambda p: F.concat_ws("|", origin, kind(p["n"]), p["v"]),
        ),
        F.lit(0),
    )
    segments = F.transform(F.split(path(url), "/"), lambda s: F.coalesce(F.try_url_decode(s), s))
    pattern = rf"(?is)^({_KEY})[:=](.+)$"
    placed = F.transform(
        segments,
        lambda s, i: F.struct(
            F.regexp_extract(s, pattern, 1).alias("n"),
            F.regexp_extract(s, pattern, 2).alias("v"),
            F.lower(F.coalesce(F.get(segments, i - 1), F.lit(""))).alias("before"),
        ),
    )
    family = r"^[\p{L}\p{N}_-]+:[\p{L}\p{N}_.-]+$"
    by_path = F.get(
        F.transform(
            F.filter(placed, lambda p: (p["n"] != "") & ~F.contains(p["v"], F.lit("-")) & good(p["v"])),
            lambda p: F.concat_ws(
                "|",
                origin,
                F.when(F.rlike(p["before"], F.lit(family)) & ~F.rlike(p["before"], F.lit(pattern)), p["before"]),
                kind(p["n"]),
                p["v"],
            ),
        ),
        F.lit(0),
    )
    return F.when(scheme(url).isin("http", "https"), F.coalesce(by_query, by_path))
