"""Company facts from analysed pages: activities with evidence, types, places, and how they meet a search's criteria.

Pages are rows; what a page says of terms are rows too (hits). A company is the
group of its pages, so every step is a grouped aggregation or a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hosts that are never a company's own site, by kind.
HOST_KINDS = {
    "directory": "kvk.nl opencorporates.com oozo.nl drimble.nl bedrijvenpagina.nl cylex.nl cylex-nederland.nl telefoonboek.nl detelefoongids.nl goudengids.nl hotfrog.nl opendi.nl infobel.com openingstijden.nl bedrijfsgegevens.nl allebedrijvenin.nl companyinfo.nl bedrijvenregister.nl bedrijfsinformatie.nl kompass.com europages.nl europages.com dnb.com zoominfo.com crunchbase.com bedrijven.nl nlbedrijven.com zorgkaartnederland.nl zorgaanbieders.nl yelp.com yelp.nl waarmoetikzijn.nl ondernemersplein.nl dun-bradstreet.com bedrijvengids.nl vindjebedrijf.nl nederlandsebedrijven.nl aanbieders.nl bedrijfspagina.nl",
    "review_or_comparison": "trustoo.nl werkspot.nl homedeal.nl offertesite.nl solvari.nl offerte.nl klantenvertellen.nl kiyoh.com trustpilot.com independer.nl vergelijk.nl offerteadviseur.nl thuisvergelijker.nl zoofy.nl",
    "social": "linkedin.com facebook.com instagram.com twitter.com x.com youtube.com tiktok.com pinterest.com threads.net",
    "jobs": "indeed.com indeed.nl nationalevacaturebank.nl werk.nl monsterboard.nl jobbird.com glassdoor.com glassdoor.nl intermediair.nl werkzoeken.nl jobat.be",
    "marketplace": "marktplaats.nl amazon.com amazon.nl bol.com ebay.com alibaba.com coolblue.nl",
    "media": "nu.nl nos.nl ad.nl telegraaf.nl rtlnieuws.nl omroepwest.nl rijnmond.nl destentor.nl gelderlander.nl bd.nl ed.nl parool.nl volkskrant.nl nrc.nl trouw.nl fd.nl mt.nl emerce.nl computable.nl dutchcowboys.nl",
    "government": "overheid.nl rijksoverheid.nl government.nl cbs.nl tenderned.nl europa.eu belastingdienst.nl",
    "search_or_maps": "google.com google.nl bing.com openstreetmap.org duckduckgo.com waze.com",
    "reference": "wikipedia.org wikidata.org reddit.com quora.com",
}
#: Roles that are a type of business, and the order of types.
ROLE_TYPES = {
    "manufacturer": "manufacturer", "wholesaler": "distributor", "distributor": "distributor",
    "service_provider": "service_provider", "installer": "service_provider", "contractor": "service_provider", "consultancy": "service_provider",
}
PROFILE_SIGNALS = ["name", "description", "activities", "industry", "customerSectors", "roles", "location", "serviceArea", "contact"]


def excluded_host_kind(host: Column, domain: Column) -> Column:
    """Why a host is never a company's own site: by its domain, else by its name; null for a candidate."""
    known = F.create_map(*(F.lit(x) for kind, names in HOST_KINDS.items() for d in names.split() for x in (d, kind)))
    named = F.when(F.rlike(host, F.lit(r"(?:^|\.)google\.[a-z.]+$|^maps\.")), F.lit("search_or_maps")).when(
        F.rlike(host, F.lit(r"(?:^|\.)(?:gov|gouv)\.[a-z.]+$")), F.lit("government")
    )
    return F.coalesce(F.try_element_at(known, domain), named)


def is_public_authority(names: Column, domain: Column) -> Column:
    """A municipality, province, ministry, water board or the like, by one of its names or its domain."""
    by_name = F.exists(names, lambda n: F.rlike(F.trim(n), F.lit(r"(?i)^(?:gemeente|provincie|ministerie|rijksoverheid|waterschap|hoogheemraadschap|veiligheidsregio|omgevingsdienst)(?![A-Za-z0-9_])")))
    return F.coalesce(by_name, F.lit(False)) | F.coalesce(F.rlike(domain, F.lit(r"(?:^|\.)(?:overheid|rijksoverheid|provincie[a-z-]*)\.nl$")), F.lit(False))


def looks_like_company(pages: DataFrame, by: str) -> DataFrame:
    """True where any page has an address, a registration, organisation data, a contact page, an e-mail or a phone."""
    said = (F.col("addresses") > 0) | (F.col("page_type") == "contact")
    for c in ("registration", "organization", "email", "phone"):
        said = said | F.col(c).isNotNull()
    return pages.groupBy(by).agg(F.bool_or(F.coalesce(said, F.lit(False))).alias("company_site"))


def activities(hits: DataFrame, by: str) -> DataFrame:
    """One row for each company and term key of rows (kind, key, label, term, supply, structural, sentences, count, url, related, ord).

    Evidence: the three best pages, those in a context of supply before structural ones before many hits. Strong: a
    customer's sector in a context of supply; anything else that is structural or in two sentences; never what is
    merely related. Terms: the first five spellings.
    """
    key = [by, "kind", "key"]
    strongest = [F.col("supply").desc(), F.col("structural").desc(), F.col("count").desc(), F.col("ord").asc()]
    first = lambda c: F.min_by(c, "ord").alias(c)
    plain = F.bool_or("structural") | (F.sum("sentences") >= 2)
    strong = ~F.bool_or("related") & F.when(F.col("kind") == "customer_sector", F.bool_or("supply")).otherwise(plain)
    said = hits.groupBy(*key).agg(first("label"), first("related"), F.when(strong, F.lit("strong")).otherwise(F.lit("weak")).alias("strength"))
    best = first_of(hits, key, strongest, 3, F.col("ord")).groupBy(*key).agg(in_rank("url").alias("evidence"))
    spelled = hits.where("term is not null").groupBy(*key, "term").agg(F.min("ord").alias("ord"))
    terms = first_of(spelled, key, [F.col("ord").asc(), F.col("term").asc()], 5, F.xxhash64("term")).groupBy(*key).agg(in_rank("term").alias("terms"))
    return said.join(best, key, "left").join(terms, key, "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def first_of(rows: DataFrame, key: list[str], order: list[Column], n: int, spread: Column, shares: int = 64) -> DataFrame:
    """The first ``n`` rows of each key, numbered by ``rank``.

    Each of ``shares`` parts of a key, dealt by ``spread``, gives its first ``n``; of those the first are taken. So a key
    with most of the rows is not one task's, and nothing longer than ``n`` is ever gathered.
    """
    part = F.pmod(F.xxhash64(spread), F.lit(shares)).alias("share")
    some = rows.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy(*key, "share").orderBy(*order))).where(F.col("rank") <= n)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= n).drop("share")


def in_rank(column: str) -> Column:
    """An aggregate of ``first_of``'s rows: the column's values in order of rank."""
    return F.transform(F.array_sort(F.collect_list(F.struct("rank", column))), lambda x: x[column])


def company_profile(pages: DataFrame, by: str) -> DataFrame:
    """Scalars of each company from its pages (ord, page_type, site_name, legal_name, org_name, phone, email, description, city, areas).

    The legal name before a brand, the home page's description before others', a contact page's phone and e-mail before
    other pages'. Cities and areas are distinct in order, at most 10 and 15.
    """
    first = lambda c, order="ord": F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order) if isinstance(order, str) else order))
    contact_first = F.struct((F.col("page_type") != "contact").cast("int").alias("k"), "ord")
    home_first = F.struct(F.when(F.col("page_type") == "home", 0).when(F.col("page_type") == "about", 1).otherwise(2).alias("k"), "ord")
    told = F.when(F.col("page_type").isin("home", "about") & F.col("description").isNotNull(), home_first)
    told_all = pages.groupBy(by).agg(
        F.coalesce(first("legal_name"), first("org_name"), first("site_name")).alias("name"),
        F.array_sort(F.collect_set("site_name")).alias("trade_names"),
        F.min_by("description", told).alias("description"),
        first("phone", contact_first).alias("phone"),
        first("email", contact_first).alias("email"),
        F.min_by("url", F.when(F.col("page_type") == "contact", F.col("ord"))).alias("contact_url"),
    )
    for column, name, most in (("city", "cities", 10), ("area", "areas", 15)):
        distinct = pages.where(F.col(column).isNotNull()).groupBy(by, column).agg(F.min("ord").alias("ord"))
        found = first_of(distinct, [by], [F.col("ord").asc(), F.col(column).asc()], most, F.xxhash64(column)).groupBy(by).agg(in_rank(column).alias(name))
        told_all = told_all.join(found, by, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return told_all


def business_types(pages: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """(company, type, strength) of rows (cart, prices, product_data, consumer_cues, business_cues) and of ``activities``.

    A web shop has a cart with three prices or product data (strong), or five prices and a consumer's wording; a
    supplier of businesses their wording, strong with two cues. Roles and strong services follow what was found.
    """
    cues = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(c))))
    sums = pages.groupBy(by).agg(
        F.bool_or("cart").alias("cart"), F.sum("prices").alias("prices"), F.bool_or("product_data").alias("data"), cues("consumer_cues").alias("consumer"), cues("business_cues").alias("business")
    )
    shop = F.col("cart") & ((F.col("prices") >= 3) | F.col("data"))
    of = lambda t, s: F.struct(F.lit(t).alias("type"), s.alias("strength"))
    level = lambda c: F.when(c, F.lit("strong")).otherwise(F.lit("weak"))
    said = sums.select(
        by,
        F.inline(
            F.array_compact(
                F.array(
                    F.when(shop | ((F.col("prices") >= 5) & (F.col("consumer") > 0)), of("consumer_webshop", level(shop))),
                    F.when(F.col("business") > 0, of("b2b_supplier", level(F.col("business") >= 2))),
                )
            )
        ),
    )
    types = F.create_map(*(F.lit(x) for pair in ROLE_TYPES.items() for x in pair))
    roles = found.where("kind = 'role'").select(by, F.try_element_at(types, F.col("key")).alias("type"), "strength").where("type is not null")
    services = found.where("kind = 'service' and strength = 'strong' and not related").select(by, F.lit("service_provider").alias("type"), F.lit("strong").alias("strength"))
    return said.unionByName(roles).unionByName(services).groupBy(by, "type").agg(F.min("strength").alias("strength"))  # strong sorts first


def profile_signals(signals: dict[str, Column]) -> tuple[Column, Column]:
    """Names of the fields that are known and of those that are not, in a fixed order."""
    known = lambda want: F.array_compact(F.array(*(F.when(F.coalesce(signals[s], F.lit(False)) == F.lit(want), F.lit(s)) for s in PROFILE_SIGNALS)))
    return known(True), known(False)


def excluded_by(companies: DataFrame, found: DataFrame, exclusions: DataFrame, by: str) -> DataFrame:
    """Companies whose strong, not merely related, activity is one that a search excludes, with the first such exclusion.

    ``exclusions``: place, key.
    """
    met = found.where("strength = 'strong' and not related").join(exclusions, "key")
    first = met.groupBy(by).agg(F.min_by("key", "place").alias("excluded_by"))
    return companies.join(first, by, "left")


def filter_companies(companies: DataFrame, facets: dict[str, str | None]) -> DataFrame:
    """Rows that have every value asked for; a facet is an array column or a plain one, and null or empty asks for nothing."""
    out = companies
    for column, wanted in facets.items():
        if wanted:
            is_list = companies.schema[column].dataType.typeName() == "array"
            out = out.where(F.array_contains(F.col(column), wanted) if is_list else F.col(column) == wanted)
    return out


def facet_options(companies: DataFrame, column: str, collation: str = "nl") -> DataFrame:
    """Distinct values of an array column with their place in the order of a language."""
    values = companies.select(F.explode(column).alias("value")).distinct()
    return values.withColumn("place", F.row_number().over(Window.orderBy(F.collate("value", collation), "value")))  # a form's choices


def expand_terms(values: DataFrame, concepts: DataFrame) -> DataFrame:
    """The terms that each value (ord, kind, value) stands for: those of the first concept named so, else the value itself.

    ``concepts``: concept, kind, place, term, one row a term. Values and terms are compared in normal form.
    """
    from gleaner.functions.text import normalize_words

    named = concepts.select("kind", normalize_words(F.col("term")).alias("norm"), "concept", "place")
    first = values.withColumn("norm", normalize_words(F.col("value"))).join(named, ["kind", "norm"], "left").groupBy("ord", "kind", "value").agg(F.min_by("concept", "place").alias("concept"))
    terms = concepts.groupBy("concept").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return first.join(terms, "concept", "left").select("ord", "kind", "value", "concept", F.coalesce("terms", F.array("value")).alias("terms"))


def scan_terms(texts: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """``found``: the terms in a text, longest first, none inside a longer one that was found before; by place.

    A term counts as whole words, with the usual endings. What longer terms took is blanked before shorter ones look.
    """
    from gleaner.functions.text import normalize_words, term_pattern

    ordered = sorted({t.lower() for t in terms}, key=lambda t: (-len(t), t))

    def look(so_far: Column, term: str) -> Column:
        pattern = term_pattern(term)
        at = F.regexp_instr(so_far["rest"], F.lit(pattern))
        blank = F.regexp_replace(so_far["rest"], pattern, " " * len(term))
        return F.struct(
            F.when(at > 0, blank).otherwise(so_far["rest"]).alias("rest"),
            F.when(at > 0, F.array_append(so_far["found"], F.lit(term))).otherwise(so_far["found"]).alias("found"),
        )

    state = F.struct(normalize_words(F.col(text)).alias("rest"), F.array().cast("array<string>").alias("found"))
    out = texts.withColumn("scan", state)
    for term in ordered:
        out = out.withColumn("scan", look(F.col("scan"), term))
    return out.withColumn("found", F.col("scan.found")).drop("scan")


def place_match(located: Column, served: Column, same_province: Column, national: Column) -> Column:
    """confirmed by a branch or a stated area there, possible by the province or the whole country, else insufficient."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(located) | yes(served), F.lit("confirmed")).when(yes(same_province) | yes(national), F.lit("possible")).otherwise(F.lit("insufficient"))


def activity_match(found: Column, related: Column, strong: Column, in_snippet: Column) -> Column:
    """A related term or a weak one is a lead, not proof; a search result alone likewise."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(related) & ~yes(found), F.lit("possible"))
        .when(yes(found), F.when(yes(strong), F.lit("confirmed")).otherwise(F.lit("possible")))
        .when(yes(in_snippet), F.lit("possible"))
        .otherwise(F.lit("insufficient"))
    )
