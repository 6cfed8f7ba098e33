"""Small derivations of records: what lists show, contacts, envelopes, cursors, places and names. Column expressions throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import EMAIL, collapse, dedupe_key, normalize_words

#: Countries of tender searches by name, as code, label, three-letter code and language.
COUNTRIES = {
    "nl nederland netherlands": ("NL", "Nederland", "NLD", "nl"),
    "be belgie belgium": ("BE", "België", "BEL", "nl"),
    "de duitsland germany": ("DE", "Duitsland", "DEU", "en"),
    "fr frankrijk france": ("FR", "Frankrijk", "FRA", "en"),
}
#: Entities that structured data keeps.
ENTITIES = [("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]
#: General mailboxes.
GENERAL_MAILBOXES = (
    "info contact sales verkoop service support office kantoor hallo hello hi algemeen receptie administratie offerte offertes orders? order bestellingen klantenservice "
    "customerservice mail post secretariaat planning inkoop welkom team vragen servicedesk helpdesk"
).split()
POSTER_FIELDS = "title company location salary hours contractType contactPerson phone email applicationUrl".split()


def local_date(value: Column) -> Column:
    """2026-11-02T08:00:00 as 02-11-2026 08:00, a bare date as 02-11-2026; anything else as it is, empty as null."""
    shown = F.regexp_replace(value, r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}).*$", "$3-$2-$1 $4:$5")
    plain = F.regexp_replace(value, r"^(\d{4})-(\d{2})-(\d{2})(?:(?!T\d{2}:\d{2}).*)?$", "$3-$2-$1")
    timed = F.rlike(value, F.lit(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"))
    return F.when(value == "", F.lit(None)).when(timed, shown).otherwise(plain)


def is_updated(created: Column, updated: Column) -> Column:
    """Changed more than a second after it was made."""
    return F.unix_micros(updated) - F.unix_micros(created) > 1_000_000


def tender_origin(system: Column, via: Column) -> Column:
    """Where a tender comes from, in a user's words."""
    return (
        F.when(system == "tenderned", F.lit("TenderNed"))
        .when(system == "ted", F.lit("TED"))
        .when(system == "website", F.when(via == "web_search", F.lit("Website (ontdekt via zoekopdracht)")).otherwise(F.lit("Website van organisatie")))
        .otherwise(F.coalesce(system, F.lit("Onbekend")))
    )


def code_summary(codes: Column) -> Column:
    """The main code (else the first) with its description, and how many more there are; null without codes."""
    main = F.coalesce(F.get(F.filter(codes, lambda c: c["main"]), F.lit(0)), F.get(codes, F.lit(0)))
    more = F.when(F.size(codes) > 1, F.concat(F.lit(" (+"), (F.size(codes) - 1).cast("string"), F.lit(")"))).otherwise(F.lit(""))
    said = F.when(F.coalesce(main["description"], F.lit("")) != "", F.concat(F.lit(" · "), main["description"])).otherwise(F.lit(""))
    return F.concat(main["code"], said, more)


def location_summary(location: Column, nuts: Column) -> Column:
    codes = F.nullif(F.array_join(nuts, ", "), F.lit(""))
    return F.nullif(F.concat_ws(" ", location, F.when(codes.isNotNull(), F.concat(F.lit("("), codes, F.lit(")")))), F.lit(""))


def location_text(address: Column, postcode: Column, city: Column) -> Column:
    return F.nullif(F.concat_ws(", ", address, F.nullif(F.concat_ws(" ", postcode, city), F.lit(""))), F.lit(""))


def area_text(scope: Column, value: Column, provinces: dict[str, str]) -> Column:
    names = F.create_map(*(F.lit(x) for pair in provinces.items() for x in pair))
    return F.when(scope == "national", F.lit("Heel Nederland")).when(scope == "province", F.coalesce(F.try_element_at(names, value), value)).otherwise(value)


def short_list(values: Column, most: int = 3) -> Column:
    """The first values and how many more there are; null for none."""
    more = F.when(F.size(values) > most, F.concat(F.lit(" (+"), (F.size(values) - most).cast("string"), F.lit(")"))).otherwise(F.lit(""))
    return F.when(F.size(values) > 0, F.concat(F.array_join(F.slice(values, 1, most), ", "), more))


def criteria_summary(query: Column, lists: dict[str, Column], where: Column, exclusions: Column) -> Column:
    """One line of what a search asks for; without a place it is the whole country."""
    listed = [F.when(F.size(v) > 0, F.concat(F.lit(f"{label}: "), F.array_join(v, ", "))) for label, v in lists.items()]
    place = F.when(F.size(where) > 0, F.array_join(where, ", ")).otherwise(F.lit("Nederland"))
    said = F.when(F.coalesce(query, F.lit("")) != "", F.concat(F.lit("Zoekterm: "), query))
    without = F.when(F.size(exclusions) > 0, F.concat(F.lit("Niet: "), F.array_join(exclusions, ", ")))
    return F.concat_ws(" · ", said, *listed, place, without)


def contact_rows(rows: DataFrame, keys: list[str], fields: dict[str, str]) -> DataFrame:
    """A row (type, value) for each field of a record that has a value; ``fields``: type to column."""
    each = F.array(*(F.struct(F.lit(t).alias("type"), F.col(c).alias("value")) for t, c in fields.items()))
    return rows.select(*keys, F.inline(F.filter(each, lambda x: F.coalesce(x["value"], F.lit("")) != "")))


def envelope(name: Column, data: Column, present: Column, missing: Column, score: Column, sources: Column, contacts: Column) -> Column:
    """A record as it is stored: display name, data, signals, score, sources (type, url, label) and contacts."""
    return F.struct(
        name.alias("display_name"),
        F.to_json(data).alias("domain_data"),
        F.struct(present.alias("present_signals"), missing.alias("missing_signals")).alias("classification"),
        score.alias("score"),
        sources.alias("sources"),
        contacts.alias("contacts"),
    )


def search_terms(*values: Column) -> Column:
    """Distinct words of three or more of a-z and 0-9, without accents of Latin-1."""
    folded = [F.translate(F.lower(F.coalesce(v, F.lit(""))), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy") for v in values]
    words = F.flatten(F.array(*(F.split(f, "[^a-z0-9]+") for f in folded)))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))


def without_places(keywords: Column, places: Column) -> Column:
    """Keywords without segments or spans of up to three words that only repeat a place; null if nothing is left.

    Longer spans go first. Where nothing is removed the keywords stay as typed.
    """
    names = F.array_remove(F.transform(F.array_compact(places), lambda p: normalize_words(p)), "")
    said = F.trim(keywords)
    segments = F.transform(F.split(said, r"[,;\n]+"), lambda s: F.trim(s))

    def kept(segment: Column) -> Column:
        words = F.filter(F.split(segment, r"\s+"), lambda w: w != "")
        state = F.struct(F.lit(0).alias("skip"), F.array().cast("array<string>").alias("words"))

        def step(a: Column, i: Column) -> Column:
            span = lambda n: F.when(F.size(words) - i >= n, normalize_words(F.array_join(F.slice(words, i + 1, F.lit(n)), " ")))
            hit = F.coalesce(*(F.when(F.array_contains(names, span(n)), F.lit(n)) for n in (3, 2, 1)), F.lit(0))
            skip = F.when(a["skip"] > 0, a["skip"]).otherwise(hit)
            return F.struct(
                F.greatest(skip - 1, F.lit(0)).alias("skip"),
                F.when(skip > 0, a["words"]).otherwise(F.array_append(a["words"], F.get(words, i))).alias("words"),
            )

        places_in = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
        left = F.aggregate(places_in, state, step)["words"]
        whole = F.array_contains(names, normalize_words(segment))
        return F.when(F.coalesce(whole, F.lit(False)), F.lit("")).otherwise(F.array_join(left, " "))

    cleaned = F.array_join(F.array_remove(F.transform(segments, kept), ""), ", ")
    same = dedupe_key(F.array_join(F.array_remove(segments, ""), ", ")) == dedupe_key(cleaned)
    return F.nullif(F.when((F.size(names) == 0) | same, said).otherwise(cleaned), F.lit(""))


def search_location(country: Column, region: Column, aliases: dict[str, str]) -> Column:
    """Struct of country, label and place: a lone region that names a country is one; a place that repeats the country goes."""
    known = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    named = lambda c: F.try_element_at(known, F.lower(text(c)))
    c, r = text(country), text(region)
    code = F.when(c.isNotNull(), named(c)).otherwise(named(r))
    label = F.when(c.isNotNull(), F.coalesce(F.initcap(named(c)), c)).otherwise(F.initcap(named(r)))
    repeats = F.when(c.isNotNull(), named(r).isNotNull() & (named(r) == code)).otherwise(named(r).isNotNull())
    return F.struct(code.alias("country"), label.alias("label"), F.when(~F.coalesce(repeats, F.lit(False)), r).alias("place"))


def board_location(site: Column, location: Column) -> Column:
    """The location text of a job board: one has no country parameter, so its text carries both."""
    both = F.nullif(F.concat_ws(", ", location["place"], location["label"]), F.lit(""))
    return F.when(site == "linkedin", both).otherwise(F.coalesce(location["place"], location["label"]))


def resolve_country(value: Column) -> Column:
    """Struct of code, label, alpha3 and language; the Netherlands where none is given, null for an unknown one."""
    pairs = [(name, v) for names, v in COUNTRIES.items() for name in names.split()]
    entry = lambda v: F.struct(*(F.lit(x).alias(n) for x, n in zip(v, ("code", "label", "alpha3", "language"), strict=True)))
    known = F.map_from_entries(F.array(*(F.struct(F.lit(n), entry(v)) for n, v in pairs)))
    key = F.translate(F.lower(F.trim(value)), "àáâäçèéêëíîïñóôöúûü", "aaaaceeeeiiinooouuu")
    return F.try_element_at(known, F.when(F.coalesce(value, F.lit("")) == "", F.lit("nl")).otherwise(key))


def decode_entities(text: Column) -> Column:
    """Each entity once, so what an ampersand's entity leaves is not decoded again."""
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)


def suggest_categories(categories: DataFrame, query: str, pinned: list[str], limit: int = 12) -> DataFrame:
    """Rows (code, label, ord) whose code begins with a query of two or more characters or whose label holds it; pinned ones first."""
    q = query.strip().lower()
    if len(q) < 2:
        return categories.limit(0)
    pin = F.coalesce(*(F.when(F.col("code") == c, F.lit(i)) for i, c in enumerate(pinned)), F.lit(len(pinned)))
    hit = F.startswith("code", F.lit(q)) | F.contains(F.lower("label"), F.lit(q)) | F.col("code").isin(pinned)
    return categories.where(hit).orderBy(pin, "ord").limit(max(0, min(30, limit)))


def salary_text(currency: Column, low: Column, high: Column, interval: Column) -> Column:
    """Currency, amount or range, and interval; null without an amount."""
    amount = F.when(low.isNotNull() & high.isNotNull(), F.concat_ws("-", low.cast("string"), high.cast("string"))).otherwise(F.coalesce(low, high).cast("string"))
    return F.when(amount.isNotNull(), F.concat_ws(" ", F.nullif(currency, F.lit("")), amount, F.nullif(interval, F.lit(""))))


def text_or_null(value: Column, longest: int) -> Column:
    """Trimmed; null if empty or if longer than allowed before trimming."""
    return F.when((F.trim(value) != "") & (F.length(value) <= longest), F.trim(value))


def poster_facts(json: Column) -> Column:
    """Struct of the fields that a model's JSON gives as texts of bounded length; anything else is null."""
    raw = F.from_json(json, "struct<" + ",".join(f"{f}:variant" for f in [*POSTER_FIELDS, "extractedText"]) + ">")
    text = lambda f, n: text_or_null(F.when(F.schema_of_variant(raw[f]) == "STRING", F.try_variant_get(raw[f], "$", "string")), n).alias(f)
    return F.struct(*(text(f, 2000 if f == "applicationUrl" else 300) for f in POSTER_FIELDS), text("extractedText", 12_000))


def phone_digits(raw: Column) -> Column:
    """Digits with a leading plus as written, nine to fifteen; null else. No country code is made up."""
    digits = F.regexp_replace(F.regexp_replace(raw, "(?i)^tel:", ""), r"[^\d+]", "")
    return F.when(F.rlike(digits, F.lit(r"^\+?\d{9,15}$")), digits)


def email_address(raw: Column) -> Column:
    """A lower-case address without scheme and query; null for anything else."""
    address = F.lower(F.trim(F.substring_index(F.regexp_replace(raw, "(?i)^mailto:", ""), "?", 1)))
    return F.when(F.rlike(address, F.lit(r"^[^\s@]+@[^\s@]+\.[a-z]{2,}$")), address)


def organization_of(nodes: Column) -> Column:
    """Struct of name, legal name, e-mail and cities of the first organisation among a page's data nodes (a JSON list); null without one."""
    schema = "array<struct<`@type`:string,name:string,legalName:string,email:string,address:array<struct<addressLocality:string,postalCode:string>>>>"
    kinds = "(?i)(?:Organization|Corporation|LocalBusiness)$"
    listed = F.filter(F.from_json(nodes, schema), lambda n: F.rlike(n["@type"], F.lit(kinds)) & (n["name"].isNotNull() | n["legalName"].isNotNull()))
    org = F.get(listed, F.lit(0))
    clean = lambda c: F.nullif(collapse(decode_entities(c)), F.lit(""))
    return F.when(
        org.isNotNull(),
        F.struct(
            clean(org["name"]).alias("name"), clean(org["legalName"]).alias("legal_name"), email_address(org["email"]).alias("email"),
            F.array_compact(F.transform(org["address"], lambda a: clean(a["addressLocality"]))).alias("cities"),
        ),
    )


def cursor_json(candidates: Column) -> Column:
    return F.to_json(candidates)


def read_cursor(json: Column, excluded: Column) -> Column:
    """Candidates (url, domain) of a cursor that are web addresses without credentials on hosts that are not excluded; one a domain, in order."""
    read = F.from_json(json, "array<struct<url:string,domain:string>>")
    good = F.filter(
        read, lambda c: F.rlike(c["url"], F.lit(r"(?i)^https?://[^/?#@\s]+(?:[/?#]|$)")) & c["domain"].isNotNull() & ~F.array_contains(excluded, c["domain"])
    )
    return F.filter(good, lambda c, i: ~F.exists(F.slice(good, F.lit(1), i), lambda b: b["domain"] == c["domain"]))


def general_mail(text: Column) -> Column:
    """The first address of a general mailbox in a text; null if only persons are named."""
    every = F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), lambda a: F.lower(a))
    return F.get(F.filter(every, lambda a: F.rlike(a, F.lit(rf"^(?:{'|'.join(GENERAL_MAILBOXES)})(?:[.-][a-z0-9_]+)?@"))), F.lit(0))
