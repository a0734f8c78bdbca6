"""Facts that texts state: quantities with their sentences, filing lines, contacts, codes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowgrid.functions.predicates import col, let


@dataclass(frozen=True)
class Kind:
    """A kind of fact: its pattern (group 1 the number, group 2 a scale), and the values that count."""

    pattern: str
    least: float = 0.0
    most: float = 1e18
    #: A number without a scale must reach this.
    bare: float = 0.0
    #: Lower-case parts one of which every match holds: other sentences needn't be searched.
    holds: tuple[str, ...] = ()


# Patterns and bounds of the kinds, and the scales.
KINDS = {
    "rooms": Kind(r"(?i)\b([\d,]{1,7})[\s-]?(?:(?:guest|hotel|luxury|resort|new|additional|branded|keyed)[\s-]?){0,2}(?:rooms?|keys)()\b", 2, 20_000, holds=("room", "keys")),
    "floors": Kind(r"(?i)\b([\d,]{1,4})[\s-]?(?:storey|story|stories|storeys|floors?|levels?)()\b", 2, 250, holds=("stor", "floor", "level")),
    "sqft": Kind(r"(?i)\b([\d,.]+)\s*(million|thousand)?\s*(?:square[\s-]?f(?:ee|oo)t|square[\s-]?foot|sq\.?\s?ft\.?)\b", holds=("sq",)),
    "seats": Kind(r"(?i)\b(?:capacity\s+of\s+)?([\d,]{2,9})[\s-]?(?:seats?|capacity)()\b", 10, holds=("seat", "capacity")),
    "money": Kind(r"(?:US)?\$\s?([\d,.]+)[\s-]*(billion|million|trillion|thousand|bn|mm|[BMKT])?\b", bare=1e6, holds=("$",)),
    "acres": Kind(r"(?i)\b([\d,.]+)[\s-]acres?()\b", holds=("acre",)),
}
SCALES = {"thousand": 1e3, "k": 1e3, "million": 1e6, "mm": 1e6, "m": 1e6, "billion": 1e9, "bn": 1e9, "b": 1e9, "trillion": 1e12, "t": 1e12}
# Words that identify no project by themselves.
PLAIN_WORDS = (
    "the", "and", "for", "project", "development", "developments", "redevelopment", "plan", "plans", "phase", "site", "improvements",
    "expansion", "campus", "center", "centre", "resort", "resorts", "hotel", "hotels", "casino", "arena", "stadium", "district", "park",
    "tower", "towers", "venue", "theatre", "theater", "museum", "convention", "entertainment", "gaming", "retail", "residences", "company",
    "group", "llc", "inc", "corp", "corporation", "holdings", "partners", "properties", "ventures", "associates", "realty", "capital",
    "estate", "real", "management", "international", "global", "national", "american", "north", "south", "east", "west", "new", "city",
    "county", "downtown", "metro", "metropolitan", "station", "square", "place", "village", "harbor", "harbour", "beach", "valley", "ranch",
    "springs", "creek", "lake", "island", "river", "heart", "point", "economic", "anaheim", "vegas", "orlando", "nashville", "phoenix",
    "oakland", "yonkers", "westchester", "miami", "antonio", "angeles", "york", "clark", "disney", "disneyland",
)
#: Mailboxes of offices, and hosts of agencies: no party's own.
AGENCY_HOST = r"(?i)(\.gov$|\.gov\.|\.us$|\.mil$|airport|county|city|district|clerk)"
OFFICE_MAILBOX = r"(?i)^(info|no-?reply|donotreply|do-?not-?reply|clerk|agendas?|notices?|planning|permits|zoning|records|webmaster|admin|contact|support|mail)$"


def sentences(c: str | Column) -> Column:
    """The text's sentences and lines, trimmed, without empty ones."""
    parts = F.split(F.coalesce(col(c), F.lit("")), r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def _number(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, ",", ""), r"\.$", "").try_cast("double")


def _facts_of(parts: Column, name: str, kind: Kind) -> Column:
    """array<struct<kind, display, value, sentence>> of one kind in the sentences ``parts``."""
    scale_of = F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair])

    def in_sentence(s: Column) -> Column:
        def fact(m: Column) -> Column:
            read = F.struct(_number(F.regexp_extract(m, kind.pattern, 1)).alias("base"), F.element_at(scale_of, F.lower(F.regexp_extract(m, kind.pattern, 2))).alias("scale"))

            def made(r: Column) -> Column:
                ok = r["base"].between(kind.least, kind.most) & (r["scale"].isNotNull() | (r["base"] >= kind.bare))
                value = r["base"] * F.coalesce(r["scale"], F.lit(1.0))
                return F.when(ok, F.struct(F.lit(name).alias("kind"), F.trim(m).alias("display"), value.alias("value"), s.alias("sentence")))

            return let(read, made)

        return F.array_compact(F.transform(F.regexp_extract_all(s, F.lit(kind.pattern), 0), fact))

    if kind.holds:
        parts = F.filter(parts, lambda s: let(F.lower(s), lambda t: reduce(or_, [F.contains(t, F.lit(w)) for w in kind.holds])))
    return F.flatten(F.transform(parts, in_sentence))


def stated_facts(c: str | Column, kinds: dict[str, Kind] = KINDS) -> Column:
    """array<struct<kind, display, value, sentence>> in the kinds' order, then the text's."""
    return F.concat(*[_facts_of(sentences(c), n, k) for n, k in kinds.items()])


def fact_rows(df: DataFrame, id: str, text: str, most: int = 6, kinds: dict[str, Kind] = KINDS, keep: Sequence[str] = ()) -> DataFrame:
    """(id, kind, place, display, value, sentence): each row's facts, one of each wording, ``most`` of a kind, behind the columns ``keep`` of their row.

    A text's facts are one row until the end, so nothing travels: sentences with
    a digit are cut once, and wordings are told apart inside the row.
    """

    def of_kind(parts: Column, n: str, k: Kind) -> Column:
        def first(found: Column) -> Column:
            said = F.transform(found, lambda f: F.lower(f["display"]))
            own = let(said, lambda w: F.slice(F.filter(found, lambda f, i: F.array_position(w, F.get(w, i)) == i + 1), 1, most))
            return F.transform(F.when(F.size(found) > 1, own).otherwise(F.slice(found, 1, most)), lambda f, i: F.struct((i + 1).alias("place"), f.alias("f")))

        return let(_facts_of(parts, n, k), first)

    numbered = let(F.filter(sentences(text), lambda x: x.rlike("[0-9]")), lambda parts: F.concat(*[of_kind(parts, n, k) for n, k in kinds.items()]))
    return df.select(id, *keep, F.explode(numbered).alias("x")).select(id, *keep, "x.f.kind", "x.place", "x.f.display", "x.f.value", "x.f.sentence")


def invented(facts: DataFrame, text: str) -> DataFrame:
    """Facts that their text, or their own sentence, doesn't hold: an extractor's fault, none of which may be written."""
    return facts.where(~F.contains(F.col(text), F.col("display")) | ~F.contains(F.col("sentence"), F.col("display")))


# What a party's name may end in without being told by it, the least of a term, what parts of a name stand between.
PARTY_SUFFIX = r"(?i)\b(llc|l\.l\.c\.|inc\.?|corp\.?|corporation|company|ltd\.?|lp|llp)\b"
LEAST_OF_TERM, PARTS = 5, r"[/|]"


def attribution_terms(name: str | Column, *parties: str | Column) -> Column:
    """Lower-case terms one of which a sentence must hold to be about the project.

    The parts of its name, the parties without what their kind is called, and
    the telling words of all of these; nothing under five characters tells.
    """
    said = lambda c: F.lower(F.coalesce(col(c), F.lit("")))
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(said(c), PARTY_SUFFIX, ""), r"[\s,;:.]+$", ""))
    told = F.concat(F.transform(F.split(said(name), PARTS), lambda x: F.trim(x)), F.array(*map(bare, parties)).cast("array<string>"))
    long = lambda xs: F.filter(xs, lambda x: F.length(x) >= LEAST_OF_TERM)

    def terms(phrases: Column) -> Column:
        words = F.flatten(F.transform(phrases, lambda x: F.split(x, r"[^a-z0-9']+")))
        return F.array_distinct(F.concat(long(phrases), F.filter(long(words), lambda w: ~w.isin(*PLAIN_WORDS))))

    return let(told, terms)


def attributed(sentence: str | Column, terms: str | Column) -> Column:
    return let(F.lower(col(sentence)), lambda s: F.exists(col(terms), lambda t: F.contains(s, t)))


def entry_facts(facts: DataFrame, id: str, terms: str) -> DataFrame:
    """Of a project's facts those about it, one of each value (or wording, without a value)."""
    key = F.coalesce(F.col("value").cast("string"), F.lower("display"))
    rows = facts.where(attributed("sentence", terms)).withColumn("__key", key)
    first = rows.groupBy(id, "kind", "__key").agg(F.min_by(F.struct("display", "value", "sentence"), "place").alias("f"), F.min("place").alias("place"))
    return first.select(id, "kind", "place", "f.*")


def labelled_lines(c: str | Column, labels: dict[str, Sequence[str]]) -> Column:
    """array<struct<kind, label, display, value, line>> of a filing's 'Label: value' lines; labels by kind, in any case."""
    lines = F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), r"\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    found = []
    for kind, names in labels.items():
        pattern = r"(?i)^(" + "|".join(names) + r")\s*[:#]\s*(.+)$"

        def fact(line: Column, kind=kind, pattern=pattern) -> Column:
            told = lambda d: F.struct(F.lit(kind).alias("kind"), F.regexp_extract(line, pattern, 1).alias("label"), d.alias("display"), _number(F.regexp_extract(d, r"^\$?([\d,.]+)", 1)).alias("value"), line.alias("line"))
            return let(F.trim(F.regexp_extract(line, pattern, 2)), told)

        found.append((pattern, fact))
    return let(lines, lambda xs: F.concat(*[_matching(xs, pattern, fact) for pattern, fact in found]))


def _matching(lines: Column, pattern: str, fact) -> Column:
    return F.transform(F.filter(lines, lambda x: x.rlike(pattern)), lambda x: fact(x))


def merged_filing_facts(facts: DataFrame, id: str) -> DataFrame:
    """(id, kind, display, value): of equal kind and value the longest wording, and no wording that begins a longer one of its kind; conditions are kept whole."""
    rows = facts.select(id, "kind", F.regexp_replace(F.trim("display"), r"\s+", " ").alias("display"), "value").distinct()
    conditions, others = rows.where("kind = 'condition'"), rows.where("kind <> 'condition'")
    longest = F.struct(F.length("display"), "display")
    valued = others.where("value is not null").groupBy(id, "kind", "value").agg(F.max_by("display", longest).alias("display")).select(id, "kind", "display", "value")
    each = valued.unionByName(others.where("value is null"))
    # a wording's beginnings, at the ends of words
    ends = F.transform(F.sequence(F.lit(1), F.size(F.split("display", " "))), lambda n: F.array_join(F.slice(F.split("display", " "), F.lit(1), n), " "))
    starts = each.select(id, "kind", F.explode(F.slice(ends, F.lit(1), F.greatest(F.size(ends) - 1, F.lit(0)))).alias("display")).distinct()
    return each.join(starts, [id, "kind", "display"], "left_anti").unionByName(conditions)


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def contacts(c: str | Column) -> Column:
    """struct<applicant, representative, presenter, email, phone> from labelled lines; an office's mailbox is no contact.

    A representative without an applicant isn't told; phone and email come from
    the labelled lines only.
    """
    labels = {"applicant": ("applicant", "owner", "owner/applicant", "property owner"), "representative": ("representative", "agent", "attorney", "contact"), "presenter": ("presented by", "presenter")}

    def told(said: Column) -> Column:
        def found(block: Column) -> Column:
            mails = F.filter(F.regexp_extract_all(block, F.lit(r"([\w.+-]+@[\w-]+\.[\w.-]*\w)"), 1), lambda m: ~F.split(m, "@")[1].rlike(AGENCY_HOST) & ~F.split(m, "@")[0].rlike(OFFICE_MAILBOX))
            phones = F.regexp_extract_all(block, F.lit(r"(\(?\b\d{3}\)?[\s.-]?\d{3}[.-]\d{4}\b)"), 1)
            return F.struct(
                said["applicant"].alias("applicant"), F.when(said["applicant"].isNotNull(), said["representative"]).alias("representative"), said["presenter"].alias("presenter"),
                F.get(mails, 0).alias("email"), F.get(phones, 0).alias("phone"),
            )

        return let(F.concat_ws("\n", *[said[k] for k in labels]), found)

    return let(let(labelled_lines(c, labels), lambda lines: F.struct(*[F.get(F.filter(lines, _of_kind(k)), 0)["display"].alias(k) for k in labels])), told)


def cpv_codes(c: str | Column) -> Column:
    """The codes of a notice's 'CPV:' line, in order, once each."""
    line = F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(?im)^\s*CPV\s*:\s*(.*)$", 1)
    return F.array_distinct(F.regexp_extract_all(line, F.lit(r"\b(\d{8})(?:-\d)?\b"), 1))
