"""Country, region and market from location strings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

US, CANADA, EMIRATES = "United States", "Canada", "United Arab Emirates"

# Names by postal codes, country codes, other spellings, regions, configured places.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut",
    "DE": "Delaware", "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois",
    "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska",
    "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina",
    "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island",
    "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia",
    "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming", "PR": "Puerto Rico",
}
PROVINCES = {
    "AB": "Alberta", "BC": "British Columbia", "MB": "Manitoba", "NB": "New Brunswick", "NL": "Newfoundland and Labrador",
    "NS": "Nova Scotia", "NT": "Northwest Territories", "NU": "Nunavut", "ON": "Ontario", "PE": "Prince Edward Island",
    "QC": "Quebec", "SK": "Saskatchewan", "YT": "Yukon",
}
#: Three-letter code, two-letter code ('' where sources don't use it) and name.
COUNTRIES = [
    ("ARE", "AE", EMIRATES), ("ARG", "", "Argentina"), ("ALB", "AL", "Albania"), ("AUS", "AU", "Australia"), ("AUT", "AT", "Austria"),
    ("AZE", "AZ", "Azerbaijan"), ("BEL", "BE", "Belgium"), ("BGR", "BG", "Bulgaria"), ("BHR", "BH", "Bahrain"), ("BHS", "", "Bahamas"),
    ("BRA", "BR", "Brazil"), ("CAN", "CA", CANADA), ("CHE", "CH", "Switzerland"), ("CHL", "", "Chile"), ("CHN", "CN", "China"),
    ("COL", "", "Colombia"), ("CRI", "", "Costa Rica"), ("CYP", "CY", "Cyprus"), ("CZE", "CZ", "Czechia"), ("DEU", "DE", "Germany"),
    ("DNK", "DK", "Denmark"), ("DOM", "", "Dominican Republic"), ("EGY", "EG", "Egypt"), ("ESP", "ES", "Spain"), ("EST", "EE", "Estonia"),
    ("ETH", "", "Ethiopia"), ("FIN", "FI", "Finland"), ("FRA", "FR", "France"), ("GBR", "GB", "United Kingdom"), ("GEO", "", "Georgia"),
    ("GRC", "GR", "Greece"), ("HRV", "HR", "Croatia"), ("HUN", "HU", "Hungary"), ("IDN", "", "Indonesia"), ("IND", "IN", "India"),
    ("IRL", "IE", "Ireland"), ("ISL", "IS", "Iceland"), ("ISR", "", "Israel"), ("ITA", "IT", "Italy"), ("JAM", "", "Jamaica"),
    ("JOR", "", "Jordan"), ("JPN", "JP", "Japan"), ("KEN", "KE", "Kenya"), ("KOR", "KR", "South Korea"), ("KWT", "KW", "Kuwait"),
    ("LTU", "LT", "Lithuania"), ("LUX", "LU", "Luxembourg"), ("LVA", "LV", "Latvia"), ("MAR", "MA", "Morocco"), ("MEX", "MX", "Mexico"),
    ("MLT", "MT", "Malta"), ("MOZ", "", "Mozambique"), ("MYS", "MY", "Malaysia"), ("NLD", "NL", "Netherlands"), ("NOR", "NO", "Norway"),
    ("NZL", "NZ", "New Zealand"), ("OMN", "OM", "Oman"), ("PER", "", "Peru"), ("PHL", "PH", "Philippines"), ("POL", "PL", "Poland"),
    ("PRT", "PT", "Portugal"), ("QAT", "QA", "Qatar"), ("ROU", "RO", "Romania"), ("SAU", "SA", "Saudi Arabia"), ("SGP", "SG", "Singapore"),
    ("SOM", "", "Somalia"), ("SRB", "RS", "Serbia"), ("SVK", "SK", "Slovakia"), ("SVN", "SI", "Slovenia"), ("SWE", "SE", "Sweden"),
    ("THA", "TH", "Thailand"), ("TUR", "TR", "Turkey"), ("USA", "US", US), ("VNM", "VN", "Vietnam"), ("ZAF", "ZA", "South Africa"),
]
OTHER_CODES = {"UK": "United Kingdom", "EL": "Greece"}
SPELLINGS = {
    "usa": US, "u.s.a.": US, "u.s.": US, "us": US, "united states of america": US, "uae": EMIRATES, "u.a.e.": EMIRATES, "uk": "United Kingdom",
    "u.k.": "United Kingdom", "great britain": "United Kingdom", "england": "United Kingdom", "scotland": "United Kingdom",
    "wales": "United Kingdom", "northern ireland": "United Kingdom", "republic of korea": "South Korea", "czech republic": "Czechia",
    "the bahamas": "Bahamas", "the netherlands": "Netherlands", "kingdom of saudi arabia": "Saudi Arabia", "ksa": "Saudi Arabia",
    "viet nam": "Vietnam", "hong kong": "Hong Kong", "macau": "Macau", "chad": "Chad",
}
EMIRATE_REGIONS = ("Dubai", "Abu Dhabi", "Sharjah", "Ras Al Khaimah", "Ajman", "Fujairah", "Umm Al Quwain")
SUBREGIONS = {
    "south florida": "Florida", "central florida": "Florida", "north florida": "Florida", "southwest florida": "Florida",
    "southern california": "California", "northern california": "California", "southern nevada": "Nevada", "northern nevada": "Nevada",
}
METROS = {
    "greater vancouver": (CANADA, "British Columbia"), "greater toronto": (CANADA, "Ontario"), "greater montreal": (CANADA, "Quebec"),
    "new york city": (US, "New York"),
}
BOROUGHS = ("manhattan", "brooklyn", "queens", "bronx", "the bronx", "staten island")
PLACES = {
    "city of anaheim": ("California", "Anaheim"), "anaheim": ("California", "Anaheim"), "city of huntington beach": ("California", "Huntington Beach"),
    "huntington beach": ("California", "Huntington Beach"), "city of las vegas": ("Nevada", "Las Vegas"), "las vegas": ("Nevada", "Las Vegas"),
    "orlando": ("Florida", "Orlando"), "kissimmee": ("Florida", "Kissimmee"), "altamonte springs": ("Florida", "Altamonte Springs"),
    "bonita springs": ("Florida", "Bonita Springs"), "lake buena vista": ("Florida", "Lake Buena Vista"), "miami": ("Florida", "Miami"),
    "broward": ("Florida", "Broward County"), "broward county": ("Florida", "Broward County"), "atlanta": ("Georgia", "Atlanta"),
    "nashville": ("Tennessee", "Nashville"), "phoenix": ("Arizona", "Phoenix"), "san antonio": ("Texas", "San Antonio"),
    "oakland": ("California", "Oakland"), "yonkers": ("New York", "Yonkers"), "city of yonkers": ("New York", "Yonkers"),
    "westchester county": ("New York", "Westchester County"), "westchester": ("New York", "Westchester County"),
    "new york city": ("New York", "New York City"), "city of new york": ("New York", "New York City"), "nyc": ("New York", "New York City"),
    **{b: ("New York", "New York City") for b in BOROUGHS},
}
MARKETS = {"las vegas strip": "Las Vegas", "the strip": "Las Vegas", **{b: "New York City" for b in BOROUGHS}}
NO_PLACE = r"(?i)^(regional|global|worldwide|various|multiple|n/?a|none|unknown|tbd|00|[0-9]+)$"
#: A region code: two letters, then up to three signs of which one is a digit, or ZZZ.
REGION_CODE = r"^[A-Z]{2}(ZZZ|(?=[0-9A-Z]{1,3}$)[0-9A-Z]*[0-9][0-9A-Z]*)$"


@dataclass(frozen=True)
class Gazetteer:
    """The tables that names and codes are looked up in; keys of names are in lower case."""

    countries: tuple = tuple(COUNTRIES)
    spellings: dict = field(default_factory=lambda: SPELLINGS)
    places: dict = field(default_factory=lambda: PLACES)
    markets: dict = field(default_factory=lambda: MARKETS)

    @property
    def names(self) -> dict[str, str]:
        return {name.lower(): name for _, _, name in self.countries} | self.spellings

    @property
    def codes(self) -> dict[str, str]:
        long = {three: name for three, _, name in self.countries}
        return long | {two: name for _, two, name in self.countries if two} | OTHER_CODES

    @property
    def regions(self) -> dict[str, tuple[str, str]]:
        """Country and region by code (upper case) and by name (lower case)."""
        out = {}
        for country, table in ((US, STATES), (CANADA, PROVINCES)):
            out |= {k: (country, v) for k, v in table.items() if k not in out}
            out |= {v.lower(): (country, v) for v in table.values()}
        return out


def _find(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _first(values: Column) -> Column:
    """The first value of an array that isn't null."""
    return F.get(F.array_compact(values), 0)


def _tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def with_geography(df: DataFrame, location: str, hint: str | None = None, tables: Gazetteer = Gazetteer(), name: str = "geography") -> DataFrame:
    """``df`` with a struct<country, region_state, market> for its ``location``.

    A configured place is never read as a code ("Bronx" is no code of Brazil).
    Codes count where every part of the string is one; then a state or
    province anywhere names the market before it; then regions, metropolitan
    areas, countries and emirates.  What names no country falls back on
    ``hint``, a column with a country's code or name; null where that is null.
    """
    names, codes, regions = tables.names, tables.codes, tables.regions
    pair = lambda table, i: {k: v[i] for k, v in table.items()}
    named = lambda x: _find(names, F.lower(x))
    code = lambda x: F.upper(x)
    is_code = lambda x: code(x).rlike("^[A-Z]{2,3}$") | code(x).rlike(REGION_CODE)
    coded = lambda x: F.when(named(x).isNull(), F.coalesce(_find(codes, code(x)), F.when(code(x).rlike(REGION_CODE), _find(codes, F.substring(code(x), 1, 2)))))
    market = lambda x: F.when(~x.rlike(NO_PLACE) & (x != ""), F.coalesce(_find(tables.markets, F.lower(x)), x))
    region = lambda x, i: F.coalesce(_find(pair(regions, i), code(x)), _find(pair(regions, i), F.lower(x)))

    raw = _tidy(F.coalesce(F.col(location), F.lit("")))
    hinted = F.lit(None).cast("string") if hint is None else F.coalesce(coded(_tidy(F.col(hint))), named(_tidy(F.col(hint))))
    parts = F.filter(F.transform(F.split(raw, ","), _tidy), lambda x: x != "")
    staged = df.withColumns({"__raw": raw, "__parts": parts, "__hint": hinted})
    raw, parts, hinted = F.col("__raw"), F.col("__parts"), F.col("__hint")
    size = F.size("__parts")
    last, before = F.get(parts, size - 1), F.get(parts, size - 2)
    staged = staged.withColumns(
        {
            "__coded": F.when(F.forall(parts, is_code), F.coalesce(_first(F.transform(parts, lambda x: F.when(F.length(x) == 3, coded(x)))), _first(F.transform(parts, coded)))),
            "__at": _first(F.transform(parts, lambda x, i: F.when(region(x, 1).isNotNull(), i))),
            "__country": F.coalesce(named(last), _first(F.transform(parts, named))),
        }
    )
    at = F.get(parts, F.col("__at"))
    emirates = {x.lower(): x for x in EMIRATE_REGIONS}
    answer = lambda country, region_, market_: F.struct(
        *[(F.lit(x) if x is None or isinstance(x, str) else x).cast("string").alias(n) for n, x in (("country", country), ("region_state", region_), ("market", market_))]
    )
    beside = F.when(size > 1, market(before))
    country_market = F.when(F.lower(beside) != F.lower(F.col("__country")), beside)
    rules = [
        ((raw == "") | (size == 0) | raw.rlike(NO_PLACE), answer(hinted, None, None)),
        (_find(pair(tables.places, 1), F.lower(raw)).isNotNull(), answer(US, _find(pair(tables.places, 0), F.lower(raw)), _find(pair(tables.places, 1), F.lower(raw)))),
        (F.col("__coded").isNotNull(), answer(F.col("__coded"), None, None)),
        ((size == 1) & named(raw).isNotNull(), answer(named(raw), None, None)),
        (F.col("__at").isNotNull(), answer(region(at, 0), region(at, 1), F.when(F.col("__at") > 0, market(F.get(parts, F.col("__at") - 1))))),
        (_find(SUBREGIONS, F.lower(raw)).isNotNull(), answer(US, _find(SUBREGIONS, F.lower(raw)), market(raw))),
        (_find(pair(METROS, 0), F.lower(last)).isNotNull(), answer(_find(pair(METROS, 0), F.lower(last)), _find(pair(METROS, 1), F.lower(last)), F.coalesce(beside, market(last)))),
        (
            F.col("__country").isNotNull(),
            answer(F.col("__country"), F.when(F.col("__country") == EMIRATES, _find(emirates, F.lower(country_market))), country_market),
        ),
        (_find(emirates, F.lower(last)).isNotNull(), answer(EMIRATES, _find(emirates, F.lower(last)), market(last))),
        (hinted.isNotNull(), answer(hinted, None, market(F.get(parts, 0)))),
    ]
    found = None
    for when, value in rules:
        found = F.when(when, value) if found is None else found.when(when, value)
    return staged.withColumn(name, found.otherwise(answer(None, None, None))).drop("__raw", "__parts", "__hint", "__coded", "__at", "__country")
