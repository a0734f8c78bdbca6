"""String, name, money and date functions, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparrowgrid.functions.predicates import col, let

# Company suffixes dropped anywhere in a name, and those popped from an entity's end.
COMPANY_WORDS = (
    "pte", "ltd", "limited", "bv", "gmbh", "nv", "co", "inc", "llc", "sarl", "pvt", "corp", "corporation", "company", "sa", "srl",
    "ag", "as", "plc", "holding", "holdings",
)
LEGAL_SUFFIXES = (
    "llc", "l.l.c", "llp", "lp", "l.p", "inc", "incorporated", "ltd", "limited", "corp", "corporation", "co", "company", "plc", "gp", "pa",
    "pc", "pllc", "trust", "partnership", "partners", "holdings", "group", "et", "al", "etal",
)
# What makes a normalised name a public body and no private party.
GENERIC_PARTY = (
    r"^(city|county|town|village|state|board|department|office|bureau|division) of\b",
    r"\b(city council|town council|county commissioners|board of (county )?commissioners)\b",
    r"\b(planning|zoning|redevelopment|housing|park|library|utility|utilities) (commission|agency|authority|board|district)\b",
    r"\b(school district|water management district|redevelopment agency|housing authority)\b",
    r"\b(public works|community development|economic development|budget and finance|finance department)\b",
    r"\b(metropolitan (council|government)|formal meeting|subcommittee|committee)\b",
    r"^(city|county|state|district|department|council|commission|board|authority|agency)$",
    r"\b(director|councilman|councilwoman|councilmember|mayor)\b",
    r"^(dcp|hpd|edc|dot|dpr|dcas|nycha|sca|hra|dsny|ddc|nypd|fdny|acs|dep)\b[\s-]",
    r"\b(department of (city planning|housing preservation|parks|transportation|design|sanitation|environmental protection))\b",
    r"\b(economic development corporation|housing authority|school construction authority)\b",
)
# What a log may not show by its name, and by its looks.
SECRET_NAME = r"(?i)(api_?key|app_(id|key)|anon_key|service_role_key|supabase_url|authorization|bearer|token|password|secret)"
SECRET_VALUE = r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b|\b[A-Za-z0-9_-]{40,}\b"
CONTENT_NAMES = ("raw_content", "title", "notes", "snippet", "body", "html", "text", "rows", "records", "payload", "data")


def company_key(c: str | Column) -> Column:
    """A company name as a join key: lower case, & as and, suffix words dropped anywhere, single spaces."""
    s = F.regexp_replace(F.lower(col(c)), "&", " and ")
    s = F.regexp_replace(s, "[^a-z0-9 ]", " ")
    s = F.regexp_replace(s, r"\b(" + "|".join(COMPANY_WORDS) + r")\b", " ")
    return F.trim(F.regexp_replace(s, " +", " "))


def entity_key(c: str | Column) -> Column:
    """An entity's first party as a key; '' for null.

    Brackets go; the name ends at a semicolon, and where a legal suffix stands
    before "&" or "and" (an "and" inside a name stays); legal suffixes are
    popped from the end and a leading "the" is dropped, but never the last word.
    """
    suffixes = "|".join(x.replace(".", r"\.") for x in LEGAL_SUFFIXES)
    name = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"\([^)]*\)", " ")
    first = F.regexp_replace(name, r"(?s)\s*;.*$", "")
    # the long pattern is asked only of names with two parties
    first = F.when(F.contains(first, F.lit("&")) | F.contains(first, F.lit("and")), F.regexp_replace(first, rf"(?s)^(.*?\b(?:{suffixes})\.?,?\s*(?:&|and)\s).*$", "$1")).otherwise(first)
    words = F.trim(F.regexp_replace(F.regexp_replace(first, r"\s+and\s+", " "), "[^a-z0-9]+", " "))
    plain = "|".join(x for x in LEGAL_SUFFIXES if "." not in x)
    return F.regexp_replace(F.regexp_replace(words, rf"(?: (?:{plain}))+$", ""), "^the (?=.)", "")


def is_generic_party(key: str | Column) -> Column:
    """Whether an ``entity_key`` is a public body, or too short to be a name."""
    body = "|".join(f"(?:{p})" for p in GENERIC_PARTY)
    return let(col(key), lambda k: (F.length(k) < 4) | k.rlike(body))


def deaccent(c: str | Column) -> Column:
    """Latin letters without their accents."""
    plain = {"a": "àáâãäåā", "c": "çćč", "e": "èéêëēę", "i": "ìíîïī", "n": "ñńň", "o": "òóôõöøō", "s": "śš", "u": "ùúûüū", "y": "ýÿ", "z": "źżž"}
    pairs = [(x, k) for k, v in plain.items() for x in v] + [(x.upper(), k.upper()) for k, v in plain.items() for x in v if len(x.upper()) == 1]
    return F.translate(col(c), "".join(x for x, _ in pairs), "".join(k for _, k in pairs))


def is_spanish(c: str | Column) -> Column:
    """Three different Spanish markers or more, and fewer than three English ones."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    es = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(el|la|los|las|del|para|por|una|con|que|y)\b"), 1)))
    en = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(the|and|of|for|with|that|to)\b"), 1)))
    return (es >= 3) & (en < 3)


def shouted_words(c: str | Column) -> Column:
    """Words of three capitals or more."""
    return F.regexp_count(col(c), F.lit(r"\b[A-Z]{3,}\b"))


def proper_case(c: str | Column) -> Column:
    """Shouted names in title case, others as they are."""
    return F.when(shouted_words(c) > 0, F.initcap(F.lower(col(c)))).otherwise(col(c))


def name_and_firm(c: str | Column) -> Column:
    """struct<person, firm> of 'Jane Doe, Firm LLC', 'Firm LLC - Jane Doe' or 'Jane Doe (Firm)'; null where a part isn't there."""
    text = F.trim(F.regexp_replace(col(c), r"\s+", " "))
    bracket = F.regexp_extract(text, r"^(.*?) ?\(([^)]+)\)$", 2)
    parts = F.when(bracket != "", F.array(F.regexp_extract(text, r"^(.*?) ?\(([^)]+)\)$", 1), bracket)).otherwise(F.split(text, r"\s+[-–]\s+|,\s*+(?!(?i:inc|llc|llp|lp|ltd|corp|co|pc|plc)\b)"))
    firm = lambda x: x.rlike(r"(?i)\b(inc|llc|llp|lp|ltd|corp|corporation|company|co|pc|plc|group|partners|associates|holdings|architects|engineers|law|firm)\b\.?")
    firms, people = F.filter(parts, firm), F.filter(parts, lambda x: ~firm(x) & x.rlike(r"^[A-Z][\w.'-]*( [A-Z][\w.'-]*){1,3}$"))
    return F.struct(F.get(people, 0).alias("person"), F.get(firms, 0).alias("firm"))


def evidence_window(c: str | Column, term: str | Column, around: int = 80) -> Column:
    """The part of the text around the term's first place, with dots where it was cut; null without it."""
    text, at = col(c), F.instr(F.lower(col(c)), F.lower(col(term)))
    start, end = F.greatest(F.lit(1), at - around), at + F.length(col(term)) + around
    cut = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, end - start), F.when(end <= F.length(text), "…").otherwise(""))
    return F.when(at > 0, cut)


def money_label(c: str | Column) -> Column:
    """$1.2bn, $3.4m, $450k."""
    v = col(c)
    return F.when(v >= 1e9, F.concat(F.lit("$"), F.format_string("%.1f", v / 1e9), F.lit("bn"))).when(v >= 1e6, F.concat(F.lit("$"), F.format_string("%.1f", v / 1e6), F.lit("m"))).otherwise(
        F.concat(F.lit("$"), F.floor(v / 1000 + 0.5).cast("string"), F.lit("k"))
    )


def tonnes(c: str | Column, least: float = 5000.0) -> Column:
    """The largest stated volume in metric tonnes of ``least`` or more; null without one."""
    pattern = r"(?i)\b([0-9][0-9,]*(?:\.[0-9]+)?)\s*(?:metric\s+)?(?:tonnes?|tons?|mt)\b"
    stated = F.transform(F.regexp_extract_all(col(c), F.lit(pattern), 1), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    return F.array_max(F.filter(stated, lambda x: x >= least))


def slug(c: str | Column, size: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, size)


def similarity(a: str | Column, b: str | Column) -> Column:
    """1 less the edit distance as a share of the longer string."""
    return 1 - F.levenshtein(col(a), col(b)) / F.greatest(F.length(col(a)), F.length(col(b)))


def host_of(c: str | Column) -> Column:
    """The host of a URL in lower case, without www."""
    return F.regexp_replace(F.regexp_extract(F.lower(col(c)), r"^[a-z][a-z0-9+.-]*://([^/:?#]+)", 1), r"^www\.", "")


def canonical_url(c: str | Column) -> Column:
    """Without fragment, tracking parameters and closing slash."""
    s = F.regexp_replace(col(c), "#.*$", "")
    s = F.regexp_replace(s, r"[?&](utm_[a-z]+|ref)=[^&]*", "")
    return F.regexp_replace(s, "/$", "")


def largest_money(c: str | Column) -> Column:
    """The largest $ amount in the text, with k, m, mm, million, bn and billion applied; null without one."""
    pattern = r"(?i)\$\s?([0-9][0-9,]*(?:\.[0-9]+)?)\s*(billion|bn|million|mm?|k)?\b"
    numbers = F.regexp_extract_all(col(c), F.lit(pattern), 1)
    units = F.regexp_extract_all(col(c), F.lit(pattern), 2)

    def scaled(number: Column, unit: Column) -> Column:
        scale = F.element_at(F.create_map(F.lit("b"), F.lit(1e9), F.lit("m"), F.lit(1e6), F.lit("k"), F.lit(1e3)), F.lower(F.substring(unit, 1, 1)))
        return F.regexp_replace(number, ",", "").try_cast("double") * F.coalesce(scale, F.lit(1.0))

    return F.array_max(F.zip_with(numbers, units, scaled))


def money_points(amount: Column, most: float = 10.0) -> Column:
    """Points to one place on a log scale from 100 thousand to a billion."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.log10(amount) - 5) / 4))
    return F.when(amount.isNull() | (amount < 1e5), 0.0).otherwise(F.floor(share * most * 10 + 0.5) / 10)


def iso_dates(c: str | Column) -> Column:
    """All valid ISO days in the text as dates, ascending, without repeats."""
    found = F.regexp_extract_all(col(c), F.lit(r"\b((?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})\b"), 1)
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(found, lambda x: x.try_cast("date")))))


def sha_key(*columns: str | Column) -> Column:
    """The first 16 hex digits of the SHA-1 of the values, one a line."""
    return F.substring(F.sha1(F.concat_ws("\n", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in columns]).cast("binary")), 1, 16)


def scrub(c: str | Column, most: int = 500) -> Column:
    """A text for the log: secrets in ``key=value`` form, tokens and long opaque values masked, the text cut to a length."""
    masked = F.regexp_replace(col(c), r"(?i)\b(token|secret|password|api[_-]?key|authorization)\b(\s*[=:]\s*)\S+", "$1$2[redacted]")
    return F.substring(F.regexp_replace(masked, SECRET_VALUE, "[redacted]"), 1, most)


def scrub_fields(fields: str | Column, most: int = 500) -> Column:
    """A map of log fields: values under secret or content names and values that look secret masked whole, key parameters of urls masked, long ones cut."""

    def clean(k: Column, v: Column) -> Column:
        secret = k.rlike(SECRET_NAME) | F.lower(k).isin(*CONTENT_NAMES) | v.rlike(SECRET_VALUE)
        plain = F.regexp_replace(v, r"(?i)([?&](?:api_?key|key|token|apikey)=)[^&]*", "$1[redacted]")
        return F.when(secret, "[redacted]").when(F.length(plain) > most, F.concat(F.substring(plain, 1, most), F.lit("...[truncated]"))).otherwise(plain)

    return F.transform_values(col(fields), clean)


def json_block(c: str | Column) -> Column:
    """From the first opening to the last closing brace, the part of a model's answer that is JSON."""
    return F.regexp_extract(col(c), r"(?s)(\{.*\})", 1)
