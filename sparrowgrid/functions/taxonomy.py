"""Vocabulary of the leisure register: venue types, the admission gate with all its rungs, categories of the lead lists."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparrowgrid.functions.predicates import any_word, col, fold_punctuation, let
from sparrowgrid.functions.rules import first_match

# Venue types by their words, first match wins.
VENUES = [
    ("Theme Park", ("disneyland", "walt disney world", "magic kingdom", "epcot", "hollywood studios", "universal studios", "universal orlando",
                    "islands of adventure", "epic universe", "six flags", "cedar point", "busch gardens", "seaworld", "sea world", "legoland")),
    ("Waterpark", ("waterpark", "water park")),
    ("Theme Park", ("theme park",)),
    ("Amusement Park", ("amusement park", "amusement")),
    ("Family Entertainment Center", ("family entertainment", "family entertainment center", "fec")),
    ("Aquarium", ("aquarium",)),
    ("Zoo", ("zoo",)),
    ("Science Center", ("science center", "science centre")),
    ("Museum", ("museum",)),
    ("Heritage/Cultural Site", ("heritage", "cultural site", "cultural center", "cultural centre", "cultural")),
    ("Integrated Resort", ("integrated resort",)),
    ("Casino/Gaming", ("casino", "gaming", "gambling")),
    ("Entertainment District", ("entertainment district", "entertainment complex")),
    ("Resort", ("resort",)),
    ("Golf/Resort Course", ("golf course", "golf club", "golf resort", "golf links")),
    ("Hotel", ("hotel", "motel", "lodge", "cabin", "lodging", "hospitality")),
    ("Convention/Expo", ("convention center", "convention centre", "convention", "exhibition center", "exhibition centre", "expo", "exposition",
                         "congress center", "congress centre")),
    ("Smart City", ("smart city",)),
    ("Master-Planned Community", ("master-planned community", "master planned community", "master-planned", "masterplanned")),
    ("Transit-Oriented Development", ("transit-oriented", "transit oriented")),
    ("Transit Hub", ("transit hub",)),
    ("Airport City", ("airport city",)),
    ("Arena/Stadium", ("arena", "stadium")),
    ("Urban Regeneration", ("urban regeneration", "urban renewal")),
    ("Downtown Redevelopment", ("downtown redevelopment", "downtown")),
    ("Waterfront Development", ("waterfront",)),
    ("Mixed-Use Development", ("mixed-use", "mixed use")),
    ("Entertainment Destination", ("visitor attraction", "tourist attraction", "visitor destination", "entertainment destination")),
]
# The gate's words.
STRONG = (
    "theme park", "amusement park", "amusement", "water park", "waterpark", "family entertainment center", "entertainment center",
    "entertainment district", "entertainment complex", "entertainment facility", "entertainment venue", "recreational facility",
    "recreation center", "integrated resort", "resort", "casino", "arena", "stadium", "ballpark", "amphitheater", "amphitheatre",
    "convention center", "exposition", "fairgrounds", "museum", "aquarium", "zoo", "cultural center", "performing arts", "visitor center",
    "attraction", "tourism improvement district", "tourism development", "marina", "pier", "master-planned community",
    "master planned community", "comprehensive plan", "downtown redevelopment", "urban regeneration", "transit-oriented development",
    "transit oriented development", "entertainment district overlay", "market square",
)
WEAK = (
    "hotel", "motel", "lodge", "cabin", "spa", "golf", "waterfront", "redevelopment", "hospitality", "tourism", "gaming", "entertainment",
    "recreation", "master plan", "masterplan", "mixed use", "mixed-use",
)
ACTION = (
    "use permit", "special use permit", "conditional use", "zone change", "rezoning", "zoning application", "plan amendment", "plat",
    "tentative map", "site plan", "design review", "variance", "waiver of development standards", "development agreement",
    "disposition and development agreement", "ground lease", "entitlement", "land use", "tax increment", "TIF", "feasibility",
    "request for proposals", "liquor license", "environmental resource permit", "permit application", "permit modification",
    "water use permit", "construction permit", "dredge and fill", "mitigation bank",
)
DEAL = (
    "development agreement", "disposition and development agreement", "disposition and redevelopment solicitation",
    "economic incentive agreement", "exclusive negotiation agreement", "reinvestment zone",
)
MIXED_USE = ("mixed use", "mixed-use")
#: Markets where "mixed use" says nothing, however small the scheme.
UNSCALED_MARKETS = ("New York City",)
#: A strong word so near the head of a text makes the instrument one about that venue.
NAMING_WINDOW = 120
_BORROWED = (
    r"(?i)\b(commercial resort|resort commercial|resort residential)\b",
    r"(?i)\b(accessory|ancillary)\s+(\w+\s+){0,2}?(recreational facility|recreation center|recreation centre|entertainment center|entertainment centre|museum|marina|pier)\b",
)
_PLAN_NAME = r"\b[A-Z][\w'&.-]*(\s+[A-Z][\w'&.-]*)*\s+Redevelopment Plan\b"
_MEETING = (
    r"(?i)^\s*([\d.]+\s*)?(notice of (a )?)?[A-Za-z' ()/-]{0,50}\b(board|commission|council|committee|authority|agency|district)\s+meeting\b",
    r"(?i)^\s*([\d.]+\s*)?(special|regular|annual|joint|adjourned)\s+meeting\b",
)
_BUDGET = (
    r"(?i)\b(amending|amendment to|amend)\s+the\s+budget\b|\bbudget\s+(amendment|transfer|adjustment|modification)\b|\bsupplemental\s+appropriation\b"
    r"|\btransferring\s+funds\s+to\s+and\s+from\b|\bappropriation\s+ordinance\b"
)
_LEVY = (
    r"(?i)\blevying\s+(the\s+|a\s+|of\s+)?tax(es)?\b|\bfixing\s+(the\s+)?rate\s+of\s+tax\b|\bcost[-\s]of[-\s]living\s+tax\s+adjustment\b"
    r"|\btax\s+levy\b|\blevy\s+of\s+taxes\b|\bsetting\s+the\s+tax\s+rate\b"
)
_DETACHED = r"(?i)\bsingle[-\s]?family\b|\bdetached (residential|dwelling|single-family)\b|\bresidential subdivision\b"
_DWELLINGS = r"(?i)\b[\d,]+\s+(residential|dwelling|apartment|housing|affordable)\s+(units?|homes?)\b"
_CIVIC = (
    r"(elementary|middle|high|primary|charter|public|nursery|grammar)\s+school\b", r"school\s+(district|campus|board)\b",
    r"(day\s?care|child\s?care)\s+(centre|center|facility)\b",
    r"(hospital|medical center|medical centre|health clinic|dialysis|nursing home|skilled nursing)\b", r"(place|house)\s+of\s+worship\b",
    r"(in conjunction with|for)\s+(an?\s+)?(existing\s+)?(church|synagogue|mosque|temple)\b", r"(homeless|emergency)\s+shelter\b",
    r"(correctional facility|detention cent(er|re)|county jail)\b",
)
#: Words that make an institution a part of something larger.
_PART_OF = r"\b(including|includes|plus|with|and|alongside|together with)\s+(\w+\s+){0,3}?"


def _blanked(c: Column, patterns: Sequence[str]) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, p, " ")
    return c


def venue_type(c: str | Column, hint: str | Column | None = None) -> Column:
    """The first venue type whose words the text holds (plan names and borrowed phrases blanked); else the hint, if it is one."""
    text = _blanked(col(c), (_PLAN_NAME, *_BORROWED))
    found = first_match([(any_word(text, words), venue) for venue, words in VENUES])
    if hint is None:
        return found
    known = {v.lower(): v for v, _ in VENUES}
    named = F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.lower(F.trim(col(hint))))
    return F.coalesce(found, named)


def governance_limb(c: str | Column) -> Column:
    """meeting, budget-ordinance or tax-levy if the text is an instrument of government and no project; else null."""
    text = F.coalesce(col(c), F.lit(""))
    subject = F.regexp_extract(text, r"^[^\r\n]*", 0)
    return first_match([(subject.rlike(_MEETING[0]) | subject.rlike(_MEETING[1]), "meeting"), (text.rlike(_BUDGET), "budget-ordinance"), (text.rlike(_LEVY), "tax-levy")])


def is_civic(c: str | Column) -> Column:
    """Whether a civic or institutional use is the subject, and not a part of a larger scheme."""
    found = F.lit(False)
    for p in _CIVIC:
        whole = F.regexp_replace(col(c), "(?i)" + _PART_OF + p, " ")
        found = found | whole.rlike(r"(?i)\b" + p)
    return found


def is_detached_residential(c: str | Column) -> Column:
    return col(c).rlike(_DETACHED)


def register_gate(c: str | Column, market: str | Column | None = None, excluded: Sequence[str] = (), outside: Sequence[str] = ()) -> Column:
    """struct<matched, reason, limb, strong_hits, weak_hits> of the whole cascade.

    Exclusions override everything; then instruments of government (unless a
    strong word stands in the naming window), strong words, words of other
    verticals, residential mixed use, weak words with an action, deals (unless
    for detached homes), weak words alone.
    """
    raw = F.coalesce(col(c), F.lit(""))
    unscaled = F.lit(False) if market is None else F.coalesce(col(market).isin(*UNSCALED_MARKETS), F.lit(False))
    # the text is read as it stands and with its punctuation folded; both are made once
    both = lambda s: let(F.struct(s["raw"].alias("raw"), s["text"].alias("text"), fold_punctuation(s["text"]).alias("folded")), lambda t: _verdict(t["raw"], t["text"], t["folded"], unscaled, excluded, outside))
    return let(F.struct(raw.alias("raw"), _blanked(raw, _BORROWED).alias("text")), both)


def _verdict(raw: Column, text: Column, folded: Column, unscaled: Column, excluded: Sequence[str], outside: Sequence[str]) -> Column:
    some = lambda words: any_word(text, words, folded) if words else F.lit(False)
    has_strong, has_weak = some(STRONG), some(WEAK)
    # single words are asked for where there is one at all
    hits = lambda has, words: F.when(has, F.array_compact(F.array(*[F.when(some([w]), F.lit(w)) for w in words]))).otherwise(F.array().cast("array<string>"))
    strong, weak = hits(has_strong, STRONG), hits(has_weak, WEAK)
    limb = F.when(~any_word(F.substring(raw, 1, NAMING_WINDOW), STRONG), governance_limb(raw))
    only_mixed = has_weak & ~some(tuple(w for w in WEAK if w not in MIXED_USE))
    reason = first_match(
        [
            (some(excluded), "excluded"),
            (limb.isNotNull(), "governance-instrument"),
            (has_strong, "strong"),
            (some(outside), "out-of-vertical"),
            (only_mixed & (unscaled | text.rlike(_DWELLINGS)), "residential-mixed-use"),
            (has_weak & some(ACTION), "weak+action"),
            (some(DEAL) & is_detached_residential(text), "deal-detached-residential"),
            (some(DEAL), "deal"),
            (has_weak, "weak-without-action"),
        ],
        "no-match",
    )
    return F.struct(reason.isin("strong", "weak+action", "deal").alias("matched"), reason.alias("reason"), limb.alias("limb"), strong.alias("strong_hits"), weak.alias("weak_hits"))


#: How a source may use the watch list: any term, strong terms only, or none.
BYPASS = {"legistar": "all", "agenda-portal": "all", "clark-tab": "all", "ceqanet": "all", "cftod-pdf": "strong", "nyc-zap": "all", "nyc-ceqr": "all", "nyc-city-record": "all"}
REFUSED = ("excluded", "governance-instrument")


def decision(reason: Column, matched: Column, source: Column, strong_watch: Column, any_watch: Column, known_entity: Column, detached: Column, single_purpose: Column) -> Column:
    """struct<admitted, reason>: the gate, then a watched target, a known entity and a single-purpose source.

    Exclusions and instruments of government can't be bypassed; detached homes
    can't be rescued by an entity.
    """
    mode = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in BYPASS.items() for x in pair]), source), F.lit("none"))
    watched = F.when(mode == "all", any_watch).when(mode == "strong", strong_watch).otherwise(False)
    open_ = ~reason.isin(*REFUSED)
    found = first_match(
        [
            (matched, reason),
            (open_ & watched, "bypass"),
            (open_ & ~detached & known_entity.isNotNull(), "known-entity"),
            (single_purpose, "single-purpose"),
        ]
    )
    return F.struct(found.isNotNull().alias("admitted"), F.coalesce(found, reason).alias("reason"))


# Categories of the lead lists.

# Countries of signal sources.
SIGNAL_COUNTRY = {"fonatur": "MX", "semarnat": "MX", "confotur": "DO", "bahamas_hoa": "BS", "nepa_jm": "JM", "cayman_cpa": "KY"}


def in_category(key: str) -> Column:
    """Rows (category, module, lead_type) of one of the lists."""
    none = F.col("category").isNull()
    rules = {
        "fuel": (F.col("category") == "fuel") | none & (F.col("module") == "fuel"),
        "consulting": (F.col("category") == "consulting") | none & F.col("module").isNotNull() & (F.col("module") != "fuel"),
        "tenders": F.col("lead_type") == "tender",
        "hiring": F.col("lead_type") == "registry",
        **{k: F.col("category") == k for k in ("feasibility", "signals", "jobs")},
    }
    return F.coalesce(rules.get(key, F.lit(True)), F.lit(False))


def in_module(key: str) -> Column:
    rules = {
        "consulting": F.col("module") == "general_consulting",
        "fuel": F.col("module") == "fuel",
        "local": F.col("module") == "food_beverage_hospitality",
        "tenders": F.col("lead_type") == "tender",
        "hiring": F.col("lead_type") == "registry",
    }
    return F.coalesce(rules.get(key, F.lit(True)), F.lit(False))


def in_jurisdiction(key: str) -> Column:
    """Rows (source, location) of a country code, or of a Mexican state named in the location."""
    if key == "all":
        return F.lit(True)
    country = F.element_at(F.create_map(*[F.lit(x) for pair in SIGNAL_COUNTRY.items() for x in pair]), F.coalesce("source", F.lit("")))
    if len(key) == 2:
        return F.coalesce(country == key, F.lit(False))
    return F.coalesce((country == "MX") & F.contains(F.lower("location"), F.lit(key.lower())), F.lit(False))


def is_archived(now: Column) -> Column:
    """Expired by status or deadline, or dead by status or notice type."""
    expired = (F.col("status") == "expired") | (F.col("deadline") < now)
    dead = (F.col("status") == "dead") | (F.col("subcategory") == "award_or_dead")
    return F.coalesce(expired, F.lit(False)) | F.coalesce(dead, F.lit(False))


@dataclass(frozen=True)
class CategoryFilter:
    """What a list is narrowed to; None leaves an axis open.  Archived rows are hidden unless asked for."""

    category: str = "all"
    include_archived: bool = False
    notice: str | None = None
    product: str | None = None
    cargo: bool = False
    sub: str | None = None
    latam: bool = False
    signal_type: str | None = None
    jurisdiction: str = "all"
    industry: str | None = None

    def predicate(self, now: Column, notice: Column | None = None, industry: Column | None = None) -> Column:
        """Rows (category, module, lead_type, status, deadline, subcategory, product_type, is_cargo, region, signal_type, source, location) of the list.

        ``notice`` and ``industry`` are a tender's own.  Fuel and tenders hide
        what is awarded or dead unless that notice is asked for; fuel without a
        product and other rows without a sub-category are 'other'.
        """
        said = lambda c, other="other": F.coalesce(F.col(c), F.lit(other))
        dead = self.category in ("fuel", "tenders") and self.notice == "award_or_dead"
        rules = [in_category(self.category)]
        if not (self.include_archived or dead):
            rules.append(~is_archived(now))
        if self.category == "fuel":
            rules += [F.coalesce("is_cargo", F.lit(False))] if self.cargo else []
            rules.append(said("subcategory", "") == self.notice if self.notice else said("subcategory", "") != "award_or_dead")
            rules += [said("product_type") == self.product] if self.product else []
        elif self.category in ("consulting", "feasibility"):
            rules += [said("subcategory") == self.sub] if self.sub else []
            rules += [said("region", "") == "LATAM_CARIB"] if self.latam and self.category == "feasibility" else []
        elif self.category == "signals":
            rules += [said("signal_type", "") == self.signal_type] if self.signal_type else []
            rules += [said("subcategory") == self.sub] if self.sub else []
            rules.append(in_jurisdiction(self.jurisdiction))
        elif self.category == "tenders":
            rules += [industry == self.industry] if self.industry else []
            rules.append(notice == self.notice if self.notice else notice != "award_or_dead")
        return reduce(and_, rules)


def tender_notice(c: str | Column, archived: Column) -> Column:
    """award_or_dead, framework, rfp or solicitation."""
    return first_match([(archived, "award_or_dead"), (any_word(c, ("framework agreement", "framework")), "framework"), (any_word(c, ("request for proposals", "request for proposal", "rfp")), "rfp")], "solicitation")


def view_filter(view: str, now: Column, days: int = 7) -> Column:
    """The named views of the register, on status, watch and created."""
    kept = F.coalesce(F.col("status") != "dismissed", F.lit(True))
    views = {
        "trash": F.col("status") == "dismissed",
        "watchlist": kept & F.col("watch"),
        "all": kept,
        "new": kept & (F.col("created") >= F.date_sub(now, days)),
    }
    return views.get(view, F.col("status") == view)

