"""Searches as rows: what each request asks of which source, and what comes back within limits. One plan for any number of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions.display import resolve_country
from gleaner.functions.text import normalize_words

#: What a search for tenders asks for, by language.
INTENTS = {
    "nl": ["aanbesteding", "offerteaanvraag", "opdracht leverancier", "inkoopkalender", "marktconsultatie", "inkoop"],
    "en": ["tender", "request for proposal RFP", "request for quotation RFQ", "procurement"],
}
#: Most results of a job board in one run, and how far beyond its target a run asks.
SITE_RESULTS, OTHER_RESULTS, OVERFETCH = {"indeed": 100, "linkedin": 30}, 30, 1.3
MOST_QUERIES, MOST_COMPANY_QUERIES = 10, 8


def _intents(first: str) -> list[str]:
    """The language's own wordings, the first two of the other in between."""
    second = "en" if first == "nl" else "nl"
    own, other = INTENTS[first], INTENTS[second]
    return [x for i, intent in enumerate(own) for x in [intent, *other[i : i + 1][: i < 2]]]


def _numbered(requests: DataFrame, key: str, texts: Column, most: Column) -> DataFrame:
    """(key, place, query): distinct texts, by lower case, without empty ones, as many as asked."""
    kept = F.filter(texts, lambda t: F.coalesce(t, F.lit("")) != "")
    lower = F.transform(kept, lambda t: F.lower(t))
    first = F.filter(kept, lambda t, i: F.array_position(lower, F.lower(t)) == i + 1)
    return requests.select(key, F.posexplode(F.slice(first, F.lit(1), most)).alias("place", "query"))


def tender_queries(requests: DataFrame, key: str, most: int = 4) -> DataFrame:
    """Queries of requests (branch, keywords, region, country): one an intent, in the country's language first.

    Without a region a country other than the Netherlands is named. A request for an unknown country gives none.
    """
    country = resolve_country(F.col("country"))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    where = F.coalesce(text("region"), F.when(country["code"] != "NL", country["label"]))
    lists = {lang: F.array(*(F.lit(x) for x in _intents(lang))) for lang in INTENTS}
    intents = F.when(country["language"] == "nl", lists["nl"]).when(country["language"] == "en", lists["en"])
    texts = F.transform(intents, lambda i: F.concat_ws(" ", i, text("branch"), text("keywords"), where))
    return _numbered(requests, key, texts, F.lit(max(1, min(most, MOST_QUERIES))))


def notice_query(country: Column, first: Column, last: Column, codes: Column, regions: Column, keywords: Column) -> Column:
    """The publisher's expert query; only literal words of the keywords enter it."""

    def any_of(field: str, values: Column) -> Column:
        each = F.transform(values, lambda p: F.concat(F.lit(f"{field}="), p, F.lit("*")))
        return F.when(F.size(values) == 1, F.get(each, F.lit(0))).when(F.size(values) > 1, F.concat(F.lit("("), F.array_join(each, " OR "), F.lit(")")))

    words = F.transform(F.regexp_extract_all(keywords, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.concat(F.lit('FT~"'), w, F.lit('"')))
    said = F.when(F.size(words) > 0, F.concat(F.lit("("), F.array_join(words, " OR "), F.lit(")")))
    day = lambda d: F.replace(d, F.lit("-"), F.lit(""))
    return F.concat_ws(
        " AND ", F.concat(F.lit("buyer-country="), country), F.concat(F.lit("publication-date>="), day(first)), F.concat(F.lit("publication-date<="), day(last)),
        any_of("classification-cpv", codes), any_of("place-of-performance", regions), said,
    )


def company_queries(requests: DataFrame, key: str, most: int = 4) -> DataFrame:
    """Up to six angles on companies, each text once, none that is only a place.

    Requests hold lists products, services, specialisations, sectors and places, texts query, role and extra, and of the
    vocabulary: noun and other_noun (what companies of the branch are called) and synonym (another word for what is sought).
    """
    at = lambda c, i=0: F.nullif(F.get(c, F.lit(i)), F.lit(""))
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    product, special, service, where = at("products"), at("specialisations"), at("services"), at("places")
    what, role, noun = F.coalesce(product, special), text("role"), text("noun")
    customer = F.concat(F.lit("voor "), at("sectors"))
    alone = service.isNull() & customer.isNull()
    extra = F.when(F.size(F.split("extra", r"\s+")) <= 4, text("extra"))
    kind = F.when(product.isNotNull(), F.lit("leverancier")).otherwise(noun)
    second = F.coalesce(at("specialisations", 1), at("products", 1), at("services", 1))
    join = lambda *parts: F.substring(F.trim(F.regexp_replace(F.concat_ws(" ", *parts), r"\s+", " ")), 1, 120)
    texts = F.array(
        join(F.coalesce(role, F.when(what.isNotNull() & alone, kind)), F.coalesce(what, F.when(service.isNull(), noun)), service, customer, where, extra),
        join(
            F.coalesce(text("synonym"), F.when(what.isNull() & service.isNull(), text("other_noun"))), F.when(what.isNotNull(), service), customer, where,
            F.when(text("synonym").isNotNull() & alone, F.when(product.isNotNull(), F.lit("bedrijf")).otherwise(noun)),
        ),
        join(noun, F.coalesce(special, service), customer, where),
        F.when(role.isNotNull() | product.isNotNull(), join(F.coalesce(role, F.lit("leverancier")), F.coalesce(what, service), customer, where)),
        join(text("query"), where),
        F.when(second.isNotNull(), join(second, F.when(at("products", 1).isNull(), noun), where)),
    )
    told = F.filter(texts, lambda t: ~t.eqNullSafe(where))
    return _numbered(requests, key, told, F.lit(max(1, min(MOST_COMPANY_QUERIES, most))))


def request_problem(request: dict[str, Column]) -> Column:
    """Why a search for companies is refused, or null: too many values, a country that is not searched, nothing to look for."""
    lists = [v for k, v in request.items() if k not in ("query", "country")]
    many = F.lit(False)
    for values in lists:
        many = many | (F.size(F.array_distinct(values)) > 10)
    subject = F.coalesce(F.trim(request["query"]), F.lit("")) != ""
    for k in ("industries", "products", "services", "specialisations", "sectors", "roles"):
        if k in request:
            subject = subject | (F.size(request[k]) > 0)
    home = F.coalesce(normalize_words(request["country"]), F.lit("nl")).isin("nl", "nederland", "netherlands", "the netherlands", "holland")
    return F.when(F.coalesce(many, F.lit(False)), F.lit("too_many_values")).when(~home, F.lit("country_not_searched")).when(~subject, F.lit("no_subject"))


def plan_sources(requests: DataFrame, key: str) -> DataFrame:
    """(key, source, place, skipped): which sources a tender search asks, official ones first, and why one is left out.

    ``requests``: country, words (what a web search could ask), search_available, sources (null for all).
    """
    order = ["ted", "tenderned", "search"]
    code = resolve_country(F.col("country"))["code"]
    rows = requests.select("*", code.alias("code"), F.posexplode(F.array(*(F.lit(s) for s in order))).alias("place", "source"))
    wanted = rows.where(F.col("sources").isNull() | F.array_contains("sources", F.col("source")))
    web = F.col("source") == "search"
    why = (
        F.when((F.col("source") == "tenderned") & (F.col("code") != "NL"), F.lit("only_dutch_tenders"))
        .when(web & (F.coalesce(F.trim("words"), F.lit("")) == ""), F.lit("no_words"))
        .when(web & ~F.col("search_available"), F.lit("no_provider"))
    )
    return wanted.select(key, "source", "place", why.alias("skipped"))


def request_size(target: Column, most: Column, least: Column, site: Column) -> Column:
    """How many results a provider is asked for: somewhat more than the target, within the run's and the site's limits."""
    size = F.greatest(F.lit(1), F.least(most, F.greatest(least, F.ceil(target * OVERFETCH).cast("int"))))
    known = F.create_map(*(F.lit(x) for pair in SITE_RESULTS.items() for x in pair))
    return F.least(size, F.when(site == "web_search", size).otherwise(F.coalesce(F.try_element_at(known, site), F.lit(OTHER_RESULTS))))


def choose_sources(registered: Column, tiers: Column, asked: Column) -> Column:
    """Struct of used and unknown: sources asked for win over those of the tier, in order of registration."""
    return F.struct(
        F.when(asked.isNotNull(), F.array_intersect(registered, asked)).otherwise(F.array_intersect(registered, tiers)).alias("used"),
        F.when(asked.isNotNull(), F.array_except(asked, registered)).otherwise(F.array().cast("array<string>")).alias("unknown"),
    )


def provider_results(rows: DataFrame, site: str, order: str, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A provider's rows up to what each site was asked for, and a row of figures for each site.

    ``sizes``: site, requested, error. A site with an error is failed without rows and partial with some.
    """
    placed = rows.join(sizes, site).withColumn("n", F.row_number().over(Window.partitionBy(site).orderBy(order)))
    kept = placed.where(F.col("n") <= F.col("requested"))
    counted = kept.groupBy(site).agg(F.count(F.lit(1)).alias("returned"))
    status = F.when(F.col("error").isNull(), F.lit("ok")).when(F.coalesce("returned", F.lit(0)) == 0, F.lit("failed")).otherwise(F.lit("partial"))
    meta = sizes.join(counted, site, "left").select(site, "requested", F.coalesce("returned", F.lit(0)).alias("returned"), status.alias("status"))
    return kept.select(*rows.columns), meta


#: Provinces that share their name with a city.
ALSO_CITIES = ["utrecht", "groningen"]


def find_places(values: DataFrame, value: str, gazetteer: DataFrame) -> DataFrame:
    """``values`` with the place or province that a value names: kind, name, province; null where it names none.

    ``gazetteer``: kind, name, alias, province; one row an alias. A province may be called one outright; those that share
    a name with a city (utrecht, groningen) must be.
    """
    asked = values.select(F.col(value).alias("asked")).distinct()
    raw = normalize_words(F.col("asked"))
    outright = F.startswith(raw, F.lit("provincie "))
    bare = F.regexp_replace(F.regexp_replace(raw, "^provincie ", ""), " provincie$", "")
    named = gazetteer.select("kind", "name", "province", normalize_words(F.col("alias")).alias("known")).distinct()
    keyed = asked.withColumns({"known": bare, "said": outright | F.rlike(raw, F.lit(" provincie$"))})
    met = keyed.join(named, "known").withColumn(
        "fits", F.when(F.col("kind") == "province", F.col("said") | ~F.col("known").isin(ALSO_CITIES)).otherwise(~F.col("said"))
    )
    best = lambda c: F.min_by(c, F.when(F.col("fits"), F.when(F.col("kind") == "place", 0).otherwise(1))).alias(c)
    found = met.groupBy("asked").agg(best("kind"), best("name"), best("province"))
    return values.join(found, values[value] == found["asked"], "left").drop("asked")


def company_identity(domain: Column) -> Column:
    """A company's identity and its home page, by its domain."""
    return F.struct(F.lower(domain).alias("identity"), F.concat(F.lit("https://"), F.lower(domain), F.lit("/")).alias("website"))


#: Wording of a registration number and of an area that a company serves, a Dutch postcode.
REGISTRATION = r"(?i)(?<![A-Za-z0-9_])(?:kvk|k\.v\.k\.?|kamer van koophandel|chamber of commerce|coc)(?:[- ]?(?:nummer|nr\.?|no\.?|number|registratie))?\s*[:.#]?\s*(\d{8})(?![A-Za-z0-9_])"
AREA_CUES = r"werkgebied|werkzaam in|actief in|actief door|door heel|in heel|in geheel|landelijk|landelijke dekking|regio|verzorgen|service in|leveren in|servicegebied|wij komen|we komen|nationwide|throughout|serving"
NATIONAL = r"(?:heel|geheel|gehele|het hele|in het hele) (?:nederland|land)|landelijk|landelijke dekking|door (?:heel )?nederland|nationwide|throughout the netherlands|all over the netherlands"
POSTCODE = r"(?<![A-Za-z0-9_])([1-9][0-9]{3})\s?([A-RT-Z][A-Z]|S[BCE-RT-Z])(?![A-Za-z0-9_])"


def registration_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, REGISTRATION, 1), F.lit(""))


def addresses_in(text: Column) -> Column:
    """Structs of street, postcode and city of a text, one a postcode, at most eight; the city is the word after the postcode."""
    found = F.regexp_extract_all(text, F.lit(rf"(?:[A-Z][\p{{L}}.' -]{{2,50}}\s\d{{1,5}}\s?[a-zA-Z]?\s*,?\s*)?{POSTCODE}\s*,?\s*(?:[A-Z][\p{{L}}'-]{{2,30}})?"), F.lit(0))
    each = F.transform(
        found,
        lambda t: F.struct(
            F.nullif(F.trim(F.regexp_extract(t, r"^(.*?\d{1,5}\s?[a-zA-Z]?)\s*,?\s*[1-9][0-9]{3}\s?[A-Z]{2}", 1)), F.lit("")).alias("street"),
            F.concat_ws(" ", F.regexp_extract(t, POSTCODE, 1), F.regexp_extract(t, POSTCODE, 2)).alias("postcode"),
            F.nullif(F.regexp_extract(t, POSTCODE + r"\s*,?\s*([A-Z][\p{L}'-]{2,30})$", 3), F.lit("")).alias("city"),
        ),
    )
    first = F.filter(each, lambda a, i: ~F.exists(F.slice(each, F.lit(1), i), lambda b: b["postcode"] == a["postcode"]))
    return F.slice(first, 1, 8)


def serves_nation(sentences: Column) -> Column:
    """True where a sentence that speaks of an area served means the whole country."""
    whole = lambda p: rf"(?<![a-z0-9])(?:{p})(?![a-z0-9])"
    return F.exists(sentences, lambda s: F.rlike(normalize_words(s), F.lit(whole(AREA_CUES))) & F.rlike(normalize_words(s), F.lit(whole(NATIONAL))))
