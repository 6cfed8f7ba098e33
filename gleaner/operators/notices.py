"""Procurement notices to tender facts: JSON of two publishers, read defensively, as column expressions.

A notice is a JSON text. Its top level is read as a map of raw values, so that a
field of an unexpected type gives null or nothing and never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions.text import collapse, once

#: Labels of the publisher's codes.
NOTICE_TYPES = {
    "cn-standard": "Aankondiging van een opdracht",
    "cn-social": "Aankondiging van een opdracht (sociaal)",
    "cn-desg": "Aankondiging van een prijsvraag",
    "can-standard": "Aankondiging van een gegunde opdracht",
    "can-social": "Aankondiging van een gegunde opdracht (sociaal)",
    "can-desg": "Resultaat van een prijsvraag",
    "can-modif": "Wijziging van een gegunde opdracht",
    "pin-only": "Voorinformatie",
    "pin-cfc-standard": "Voorinformatie met oproep tot mededinging",
    "pin-rtl": "Voorinformatie (beperkte termijn)",
    "pmc": "Marktconsultatie",
    "veat": "Vrijwillige transparantie vooraf",
    "cn-standard-corr": "Rectificatie",
}
PROCEDURES = {
    "open": "Openbaar",
    "restricted": "Niet-openbaar",
    "neg-w-call": "Mededingingsprocedure met onderhandeling",
    "neg-wo-call": "Onderhandelingsprocedure zonder mededinging",
    "comp-dial": "Concurrentiegerichte dialoog",
    "innovation": "Innovatiepartnerschap",
    "oth-mult": "Overig (meervoudig)",
    "oth-single": "Overig (enkelvoudig)",
}
CONTRACTS = {"works": "Werken", "services": "Diensten", "supplies": "Leveringen"}
#: Languages in order of preference, the zone of local deadlines, the address of notices.
LANGUAGES = ["nld", "eng", "mul"]
LOCAL_ZONE = "Europe/Amsterdam"
NOTICE_ORIGIN = "https://ted.europa.eu/"
#: Country domains that say where a site is from (uk stands for GB).
COUNTRY_DOMAINS = (
    "nl be de fr es it pt at ch dk se no fi ie lu cz sk hu pl gr ro bg hr si lt lv ee mt cy us ca au nz jp cn in br mx za kr sg ae il tr ua"
).split()

_MAP, _LIST = "map<string,string>", "array<string>"


def fields_of(json: Column) -> Column:
    """The top level of a JSON object as a map of raw values; null for anything else."""
    return F.from_json(json, _MAP)


def clean(value: Column, longest: int = 500) -> Column:
    """Collapsed and cut; null if empty."""
    return F.nullif(F.substring(collapse(value), 1, longest), F.lit(""))


def strings(raw: Column, longest: int = 500) -> Column:
    """The cleaned strings of a raw value that is a list or a single one, without empty ones; an empty array for null."""
    items = F.coalesce(F.from_json(raw, _LIST), F.when(raw.isNotNull(), F.array(raw)), F.array().cast(_LIST))
    return F.filter(F.transform(items, lambda v: clean(v, longest)), lambda v: v.isNotNull())


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def pick_language(raw: Column, longest: int = 500) -> Column:
    """Strings of the preferred language of a ``{language: value or list}`` object, else of the first that has any."""

    def of_languages(languages: Column) -> Column:
        preferred = F.array(*(strings(F.try_element_at(languages, F.lit(x)), longest) for x in LANGUAGES))
        rest = F.transform(F.map_entries(languages), lambda e: strings(e["value"], longest))
        every = F.concat(preferred, F.coalesce(rest, F.array().cast("array<array<string>>")))
        return F.coalesce(_first(F.filter(every, lambda v: F.size(v) > 0)), F.array().cast(_LIST))

    return once(F.from_json(raw, _MAP), of_languages)


def _labelled(code: Column, labels: dict[str, str]) -> Column:
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(F.try_element_at(known, code), code)


def local_deadlines(dates: Column, times: Column) -> Column:
    """Deadlines in local time without offset, from lists of dates and times.

    The offset is the time's, else the date's; without one the time is local already, and a date without a
    time stays a date. The first time serves where a date has none of its own.
    """

    def one(entry: Column, i: Column) -> Column:
        day = F.nullif(F.regexp_extract(entry, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
        said = F.coalesce(F.get(times, i), F.get(times, F.lit(0)), F.lit(""))
        clock = F.nullif(F.regexp_extract(said, r"^(\d{2}:\d{2}:\d{2})", 1), F.lit(""))
        offset = F.coalesce(
            F.nullif(F.regexp_extract(said, r"^\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})", 1), F.lit("")),
            F.nullif(F.regexp_extract(entry, r"(Z|[+-]\d{2}:\d{2})$", 1), F.lit("")),
        )
        zone = F.when(offset == "Z", F.lit("+00:00")).otherwise(offset)
        stated = F.concat(day, F.lit("T"), clock)
        moment = F.convert_timezone(zone, F.lit(LOCAL_ZONE), F.concat_ws(" ", day, clock).try_cast("timestamp_ntz"))
        return F.when(clock.isNull(), day).otherwise(F.coalesce(F.replace(moment.cast("string"), F.lit(" "), F.lit("T")), stated))

    return F.filter(F.transform(dates, one), lambda v: v.isNotNull())


def amount(value: Column) -> Column:
    """A finite number that is not negative, else null."""
    n = clean(value, 40).try_cast("double")
    return F.when((n >= 0) & (n < float("inf")), n)


def estimated_value(fields: Column) -> Column:
    """Struct of amount and currency: the procedure's, else the sum over the lots if all have a value and one currency."""
    field = lambda name: F.try_element_at(fields, F.lit(name))
    whole, currency = amount(field("estimated-value-proc")), _first(strings(field("estimated-value-cur-proc")))
    lots = F.transform(F.from_json(field("estimated-value-lot"), _LIST), amount)
    currencies = strings(field("estimated-value-cur-lot"))
    summed = (F.size(lots) > 0) & F.forall(lots, lambda v: v.isNotNull()) & (F.size(F.array_distinct(currencies)) == 1)
    total = F.aggregate(lots, F.lit(0.0), lambda a, v: a + v)
    pair = lambda a, c: F.struct(a.alias("amount"), c.alias("currency"))
    return F.when(whole.isNotNull() & currency.isNotNull(), pair(whole, currency)).when(summed, pair(total, _first(currencies)))


def notice_url(fields: Column, number: Column) -> Column:
    """The publisher's own link, Dutch, English, then any, if it leads to the publisher; else the canonical address."""
    links = F.from_json(F.try_element_at(fields, F.lit("links")), _MAP)
    html = F.coalesce(*(F.from_json(F.try_element_at(links, F.lit(k)), _MAP) for k in ("html", "htmlDirect")))
    link = F.coalesce(F.try_element_at(html, F.lit("NLD")), F.try_element_at(html, F.lit("ENG")), _first(F.map_values(html)))
    return F.when(F.startswith(link, F.lit(NOTICE_ORIGIN)), link).otherwise(F.concat(F.lit(f"{NOTICE_ORIGIN}en/notice/-/detail/"), number))


def _facts_of_notice(f: Column) -> Column:
    """Struct of a notice's facts from the map of its fields."""
    field = lambda name: F.try_element_at(f, F.lit(name))
    number, kind = clean(field("publication-number"), 20), clean(field("notice-type"), 40)
    cpv = F.array_distinct(F.filter(strings(field("classification-cpv")), lambda c: F.rlike(c, F.lit(r"^\d{8}$"))))
    nuts = F.filter(strings(field("place-of-performance")), lambda c: F.rlike(c, F.lit("^[A-Z]{2}[A-Z0-9]{1,3}$")) & ~F.rlike(c, F.lit("^[A-Z]{3}$")))
    procedure = clean(field("procedure-type"), 40)
    contract = F.array_distinct(F.transform(strings(field("contract-nature")), lambda c: _labelled(c, CONTRACTS)))
    title = F.coalesce(*(_first(pick_language(field(k))) for k in ("title-proc", "title-lot", "notice-title")))
    deadlines = local_deadlines(strings(field("deadline-receipt-tender-date-lot")), strings(field("deadline-receipt-tender-time-lot")))
    return F.struct(
        F.coalesce(clean(field("procedure-identifier"), 60), clean(field("notice-identifier"), 60), F.concat(F.lit("publicatie-"), number)).alias("tender_identity"),
        number.alias("publication_id"),
        title.alias("title"),
        F.nullif(F.array_join(F.array_distinct(pick_language(field("buyer-name"))), "; "), F.lit("")).alias("authority"),
        kind.alias("notice_type"),
        _labelled(kind, NOTICE_TYPES).alias("notice_label"),
        _labelled(procedure, PROCEDURES).alias("procedure"),
        F.nullif(F.array_join(contract, " / "), F.lit("")).alias("contract"),
        F.transform(cpv, lambda c, i: F.struct(c.alias("code"), (i == 0).alias("main"))).alias("cpv"),
        F.array_distinct(nuts).alias("nuts"),
        F.nullif(F.regexp_extract(clean(field("publication-date"), 40), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")).alias("published"),
        F.array_min(deadlines).alias("deadline"),
        estimated_value(f).alias("value"),
        _first(pick_language(field("description-proc"), 10_000)).alias("description"),
        notice_url(f, number).alias("source_url"),
    )


def map_notices(notices: DataFrame, json: str = "json") -> DataFrame:
    """Tender facts of notices whose fields are lists with one entry a lot; a notice without a number gives no row.

    Codes and places lose repeats, the deadline is the earliest. Further columns stay in front. A notice is parsed once.
    """
    others = [c for c in notices.columns if c != json]
    # a generator's output is a column of its own, which later expressions read and never work out again
    parsed = notices.select(*others, F.explode(F.array(fields_of(F.col(json)))).alias("f"))
    facts = parsed.select(*others, F.explode(F.array(_facts_of_notice(F.col("f")))).alias("facts"))
    return facts.select(*others, "facts.*").where("publication_id is not null")


def _coded(raw: Column) -> tuple[Column, Column]:
    entry = F.from_json(raw, _MAP)
    return clean(F.try_element_at(entry, F.lit("code")), 40), clean(F.try_element_at(entry, F.lit("omschrijving")), 200)


def _keep_first(entries: Column) -> Column:
    """Structs without those whose code stood before."""
    return F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda b: b["code"] == e["code"]))


def _value_of(detail: Column) -> Column:
    """Only a value that the publisher states, under one of its names: a number, or an object with a number."""
    out = []
    for name in ("geraamdeWaarde", "geschatteWaarde", "geschatteOpdrachtwaarde"):
        raw = F.try_element_at(detail, F.lit(name))
        entry = F.from_json(raw, _MAP)
        plain = F.when(F.rlike(raw, F.lit(r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$")), raw.try_cast("double"))
        inner = F.coalesce(*(F.try_element_at(entry, F.lit(k)).try_cast("double") for k in ("bedrag", "waarde")))
        currency = F.coalesce(clean(F.try_element_at(entry, F.lit("valuta")), 3), F.lit("EUR"))
        out.append(
            F.when(plain.isNotNull(), F.struct(plain.alias("amount"), F.lit("EUR").alias("currency"))).when(
                inner.isNotNull(), F.struct(inner.alias("amount"), currency.alias("currency"))
            )
        )
    return F.coalesce(*out)


def map_publications(entries: DataFrame, details: DataFrame, key: str, entry_json: str = "json", detail_json: str = "json") -> DataFrame:
    """Tender facts of list entries and, where there is one, the detail with the same ``key``.

    A detail that is missing or could not be fetched (null) leaves what the entry says. Entries without a number give no row.
    """
    detail = details.select(F.col(key).alias("detail_key"), fields_of(F.col(detail_json)).alias("d"))
    both = entries.select(key, fields_of(F.col(entry_json)).alias("l")).join(detail, F.col(key) == F.col("detail_key"), "left")
    l = lambda name: F.try_element_at(F.col("l"), F.lit(name))
    d = lambda name: F.try_element_at(F.col("d"), F.lit(name))
    day = lambda raw: F.nullif(F.regexp_extract(raw, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    number = clean(l("publicatieId"), 20)
    type_code, type_label = _coded(l("typePublicatie"))
    item = lambda raw: F.from_json(raw, "array<map<string,string>>")
    cpv = F.filter(
        F.transform(
            item(d("cpvCodes")),
            lambda e: F.struct(
                F.substring_index(clean(F.try_element_at(e, F.lit("code")), 20), "-", 1).alias("code"),
                clean(F.try_element_at(e, F.lit("omschrijving")), 300).alias("description"),
                F.coalesce(F.try_element_at(e, F.lit("isHoofdOpdracht")) == "true", F.lit(False)).alias("main"),
            ),
        ),
        lambda e: F.coalesce(F.rlike(e["code"], F.lit(r"^\d{8}$")), F.lit(False)),
    )
    nuts = F.filter(
        F.transform(
            item(d("nutsCodes")),
            lambda e: F.struct(clean(F.try_element_at(e, F.lit("code")), 10).alias("code"), clean(F.try_element_at(e, F.lit("omschrijving")), 200).alias("description")),
        ),
        lambda e: e["code"].isNotNull(),
    )
    none = F.array().cast("array<struct<code:string,description:string,main:boolean>>")
    ted = clean(d("pbNummerTed"), 20)
    return (
        both.where(number.isNotNull())
        .withColumns({"cpv": F.coalesce(_keep_first(cpv), none), "nuts": _keep_first(nuts)})
        .select(
            key,
            F.coalesce(clean(l("kenmerk"), 40), clean(d("kenmerk"), 40), F.concat(F.lit("publicatie-"), number)).alias("tender_identity"),
            number.alias("publication_id"),
            F.coalesce(clean(l("aanbestedingNaam")), clean(d("aanbestedingNaam"))).alias("title"),
            F.coalesce(clean(l("opdrachtgeverNaam")), clean(d("opdrachtgeverNaam"))).alias("authority"),
            clean(d("referentieNummer"), 100).alias("reference"),
            type_code.alias("notice_type"),
            type_label.alias("notice_label"),
            F.coalesce(_coded(l("procedure"))[1], _coded(d("procedureCode"))[1]).alias("procedure"),
            F.coalesce(_coded(l("typeOpdracht"))[1], _coded(d("typeOpdrachtCode"))[1]).alias("contract"),
            "cpv",
            F.coalesce(F.transform("nuts", lambda e: e["code"]), F.array().cast(_LIST)).alias("nuts"),
            F.nullif(F.array_join(F.array_distinct(F.array_compact(F.transform("nuts", lambda e: e["description"]))), ", "), F.lit("")).alias("location"),
            F.coalesce(day(l("publicatieDatum")), day(d("publicatieDatum"))).alias("published"),
            F.coalesce(clean(l("sluitingsDatum"), 40), clean(d("sluitingsDatum"), 40)).alias("deadline"),
            _value_of(F.col("d")).alias("value"),
            F.coalesce(clean(l("opdrachtBeschrijving"), 10_000), clean(d("opdrachtBeschrijving"), 10_000)).alias("description"),
            F.when(F.rlike(ted, F.lit(r"^\d{1,8}-\d{4}$")), ted).alias("ted_number"),
        )
    )


def page_country(host: Column, address_countries: Column) -> Column:
    """The country that a page states: its country domain and the addresses in its data name exactly one; else null."""
    domain = F.substring_index(F.lower(host), ".", -1)
    own = F.when(domain == "uk", F.lit("GB")).when(domain.isin(COUNTRY_DOMAINS), F.upper(domain))
    named = F.filter(F.transform(F.coalesce(address_countries, F.array().cast(_LIST)), lambda c: F.upper(F.trim(c))), lambda c: F.rlike(c, F.lit("^[A-Z]{2}$")))
    every = F.array_distinct(F.array_compact(F.array_append(named, own)))
    return F.when(F.size(every) == 1, _first(every))


def location_status(country: Column, wanted: str | None) -> Column:
    """confirmed, unconfirmed (the page names no country) or foreign; null without a wanted country."""
    if wanted is None:
        return F.lit(None).cast("string")
    return F.when(country.isNull(), F.lit("unconfirmed")).when(country == wanted, F.lit("confirmed")).otherwise(F.lit("foreign"))


def tender_page_identity(url: Column) -> Column:
    """Host and path without a slash at the end, with the parameters that name an item, sorted; null for no URL."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"(?s)^[^:]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    names = F.filter(
        F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"),
        lambda p: F.rlike(F.substring_index(p, "=", 1), F.lit("(?i)^(?:id|nid|tenderid|tender|kenmerk|ref|reference|item|p|page_id|post)$")),
    )
    query = F.array_join(F.array_sort(names), "&")
    return F.when(
        host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    )


def visit_key(url: Column) -> Column:
    """Scheme and identity: one for a page however its address is written; null for no URL."""
    return F.concat(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lit("://"), tender_page_identity(url))


def numbered_repeats(rows: DataFrame, within: list[str], key: str, order: str, out: str) -> DataFrame:
    """``out``: the key, with -2, -3 ... for its second and later rows in order ``within`` a page."""
    n = F.row_number().over(Window.partitionBy(*within, key).orderBy(order))
    return rows.withColumn(out, F.when(n > 1, F.concat(F.col(key), F.lit("-"), n.cast("string"))).otherwise(F.col(key)))


def identity_key(system: Column, identity: Column) -> Column:
    """Publisher and identity in one; null unless both are given."""
    return F.when((system != "") & (identity != ""), F.concat_ws("|", system, identity))
