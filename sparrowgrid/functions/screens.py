"""What a run is restricted to, and records that are screened out or told apart by their shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowgrid.functions.facts import cpv_codes
from sparrowgrid.functions.predicates import any_word, col, word_hits
from sparrowgrid.functions.rules import first_match
from sparrowgrid.functions.text import deaccent

# Phrases of brokers, places of high risk, codes of consultancy, the least of a scope's term.
BROKER = (
    "ICPO", "LOI", "BCL", "SBLC", "FCO", "soft corporate offer", "ready willing and able", "mandate", "tank-to-tank", "TTT", "TTO", "dip and pay",
    "Rotterdam allocation", "performance bond", "Bonny Light procedure",
)
#: Those of one plain word.
BROKER_SHORT = tuple(w for w in BROKER if w.isalpha())
HIGH_RISK = (
    "cuba", "iran", "north korea", "russia", "belarus", "venezuela", "myanmar", "burma", "sudan", "south sudan", "nicaragua", "afghanistan",
    "yemen", "syria", "somalia", "libya", "haiti", "ukraine", "crimea", "donetsk", "luhansk", "sinaloa", "michoacan", "tamaulipas", "guerrero",
    "colima", "zacatecas",
)
CONSULTANCY_CPV = ("79415000", "79418000", "79419000", "71241000")
CPV_SOURCE = "tedeu"
LEAST_TERM = 3
# Patterns of a name's shape.
RESIDUE = r"\bapplicant\b|for possible action|possible action to|public hearing|abeyance|renotification"
SHOUTED_LEAD = r"^[A-Z][A-Z ,&'.-]{6,}:\s"
OPENING = r"^(?:[a-z]|(?:approving|authorizing|providing|accepting|amending|adopting|establishing|creating|declaring|conduct|issuance|OF THE\b)\b)"
FIELD_BLOCK = r"\b(?:From|Recommendation|Sponsors?|Attachments?)\s*:"
INSTRUMENT = r"(?i)^(?:liquor\s+license|bond\s+act|add[-\s]?on|license\s+application|special\s+event\s+permit)\b"
REFERENCE = r"\((?=[^)]*\d)[A-Za-z0-9][A-Za-z0-9._/-]*\)\s*$"


def plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def term_in_scope(term: str, label: str | Column) -> Column:
    """Whether a term of a scope means the label: the same words, or one beginning with all words of the other; terms under three characters mean nothing."""
    asked = " ".join("".join(x if x.isascii() and x.isalnum() else " " for x in term.lower()).split())
    if len(asked) < LEAST_TERM:
        return F.lit(False)
    here = plain(col(label))
    return (here != "") & ((here == asked) | here.startswith(asked + " ") | F.startswith(F.lit(asked), F.concat(here, F.lit(" "))))


def in_scope(markets: Sequence[str] | None = None, sources: Sequence[str] | None = None, pipeline: str | None = None) -> Column:
    """Rows (market, source, pipeline) that a run restricted so takes; None leaves an axis open, a row without a market is in no market."""
    some = lambda terms, c: F.coalesce(F.exists(F.array(*[term_in_scope(t, c) for t in terms]), lambda x: x), F.lit(False)) if terms else F.lit(True)
    # a source may also be asked for by a name too short for a term
    by_name = F.coalesce(plain(F.col("source")).isin(*[" ".join(x.lower().split()) for x in sources]), F.lit(False)) if sources else F.lit(True)
    same = plain(F.col("pipeline")) == plain(F.lit(pipeline)) if pipeline else F.lit(True)
    return some(markets, "market") & (some(sources, "source") | by_name) & F.coalesce(same, F.lit(False))


def broker_phrases(c: str | Column) -> Column:
    """The phrases of commodity brokers that the text holds; one makes it noise."""
    return word_hits(c, BROKER)


def is_high_risk(c: str | Column) -> Column:
    """Whether the location names a country or region of high risk, accents or not."""
    return F.coalesce(any_word(deaccent(col(c)), HIGH_RISK), F.lit(False))


def consultancy_codes(source: str | Column, body: str | Column) -> Column:
    """The consultancy codes among a tender's codes; only one source states them."""
    return F.when(col(source) == CPV_SOURCE, F.array_intersect(cpv_codes(body), F.array(*map(F.lit, CONSULTANCY_CPV)))).otherwise(F.array().cast("array<string>"))


def is_provisional(c: str | Column) -> Column:
    """Names assembled from a title, or nobody knows how."""
    return F.coalesce(col(c) == "title", F.lit(True))


def name_shape(name: str | Column, published: str | Column, stream: str | Column, key: str | Column, programme: str | Column) -> Column:
    """The shape of a project's name, by the first rule that holds; ``published`` tells that its source names projects itself."""
    n, k = F.coalesce(col(name), F.lit("")), F.coalesce(col(key), F.lit(""))
    own = F.coalesce(col(published), F.lit(False))
    return first_match(
        [
            (own & n.rlike(REFERENCE), "reference-suffix"),
            (own, "published-name"),
            (F.coalesce(col(programme), F.lit(False)) | F.contains(k, F.lit(":proj:")), "tender-title"),
            (F.coalesce(col(stream) == "intelligence", F.lit(False)) | k.startswith("name:"), "press-headline"),
            (n.rlike(FIELD_BLOCK), "field-block"),
            (n.rlike(INSTRUMENT), "instrument-label"),
            (n.rlike(RESIDUE) | n.rlike(SHOUTED_LEAD), "agenda-residue"),
            (n.rlike(OPENING), "opening-clause"),
            (n.rlike(REFERENCE), "reference-suffix"),
        ],
        "other",
    )


def declared(rows: DataFrame, table: DataFrame, market: str = "market", region: str = "region") -> DataFrame:
    """``rows`` with ``declared``: whether ``table`` (market, region) names their market in any case, and their region too where both have one."""
    home = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    # a market's declarations are one row, so none of rows repeats
    known = table.select(home(market).alias("__m"), home(region).alias("__r")).where("__m <> ''").groupBy("__m").agg(F.collect_set("__r").alias("__rs"))
    joined = rows.withColumn("__m", home(market)).withColumn("__here", home(region)).join(known, "__m", "left")
    agrees = (F.col("__here") == "") | F.array_contains("__rs", F.col("__here")) | F.array_contains("__rs", "")
    return joined.withColumn("declared", F.coalesce(agrees & F.col("__rs").isNotNull(), F.lit(False))).drop("__m", "__here", "__rs")


def batch_size(terms: int, domains: int, most: int, least: int = 8) -> int:
    """The smallest number of domains a search, ``least`` or more, with which all terms take fewer than ``most`` searches."""
    size = max(1, least)
    while terms * -(-domains // size) >= most and size < domains:
        size += 1
    return size
