"""Queries on places and dates stated in text."""

from pyspark.sql import functions as F

from sparrowgrid.functions import dates as D
from sparrowgrid.functions import geography as G
from sparrowgrid.plans.registry import query
from sparrowgrid.session import read, read_spread

# Locations with the country, region and market they stand for.
LOCATIONS = [
    ("Bronx", "United States", "New York", "New York City"), ("The Bronx", "United States", "New York", "New York City"),
    ("Queens", "United States", "New York", "New York City"), ("Staten Island", "United States", "New York", "New York City"),
    ("New York City", "United States", "New York", "New York City"), ("Yonkers", "United States", "New York", "Yonkers"),
    ("Westchester County", "United States", "New York", "Westchester County"), ("Anaheim", "United States", "California", "Anaheim"),
    ("Las Vegas", "United States", "Nevada", "Las Vegas"), ("Las Vegas, NV", "United States", "Nevada", "Las Vegas"),
    ("Clark County, NV", "United States", "Nevada", "Clark County"), ("Chicago,  Illinois, USA", "United States", "Illinois", "Chicago"),
    ("CZ010, CZE", "Czechia", None, None), ("ROU", "Romania", None, None), ("FIN", "Finland", None, None), ("HUN, HU322", "Hungary", None, None),
    ("PL637, POL, PL417", "Poland", None, None), ("USA", "United States", None, None),
    ("Abu Dhabi, United Arab Emirates", "United Arab Emirates", "Abu Dhabi", "Abu Dhabi"), ("Saudi Arabia", "Saudi Arabia", None, None),
    ("Toronto, ON", "Canada", "Ontario", "Toronto"), ("Burnaby, Greater Vancouver", "Canada", "British Columbia", "Burnaby"),
    ("South Florida", "United States", "Florida", "South Florida"), ("Regional", None, None, None), ("00", None, None, None),
    ("Georgia", "Georgia", None, None), ("Atlanta, Georgia", "United States", "Georgia", "Atlanta"), ("Somalia, Federal Republic of", "Somalia", None, None),
    ("Chad", "Chad", None, None), ("Brooklyn, NY", "United States", "New York", "New York City"), ("Dubai", "United Arab Emirates", "Dubai", "Dubai"),
    ("Springfield", None, None, None), ("", None, None, None), (None, None, None, None), ("Lyon, France", "France", None, "Lyon"),
]


def _sql(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


@query(
    "geography_of",
    "SELECT c_custkey, v.country, v.region_state, v.market FROM customer JOIN (VALUES "
    + ", ".join(f"({k}, {_sql(c)}, {_sql(r)}, {_sql(m)})" for k, (_, c, r, m) in enumerate(LOCATIONS))
    + f") v(k, country, region_state, market) ON c_custkey % {len(LOCATIONS)} = v.k",
)
def geography_of(spark, sf_dir):
    """Country, region and market of every customer's location."""
    places = F.array(*[F.lit(x[0]).cast("string") for x in LOCATIONS])
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.get(places, (F.col("c_custkey") % len(LOCATIONS)).cast("int")).alias("location"))
    return G.with_geography(rows, "location").select("c_custkey", "geography.*")


@query(
    "geography_hint",
    """SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'Germany' WHEN 1 THEN 'Germany' WHEN 2 THEN NULL ELSE 'Poland' END AS country,
       CASE n_nationkey % 4 WHEN 0 THEN 'Somewhere ' || n_nationkey END AS market FROM nation""",
)
def geography_hint(spark, sf_dir):
    """An adapter's country counts only where the location names none."""
    k = F.col("n_nationkey") % 4
    rows = read(spark, sf_dir, "nation").select(
        "n_nationkey",
        F.when(k == 0, F.concat(F.lit("Somewhere "), "n_nationkey")).when(k == 1, "Global").when(k == 2, "Nowhere").otherwise("Poland").alias("location"),
        F.when(k != 2, F.when(k == 1, "Germany").otherwise("DE")).alias("hint"),
    )
    return G.with_geography(rows, "location", "hint").select("n_nationkey", "geography.country", "geography.market")


@query(
    "free_dates",
    """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 6 AS k FROM orders)
       SELECT o_orderkey, CAST(CASE WHEN k < 3 THEN d WHEN k = 3 THEN date_trunc('month', d) WHEN k = 4 THEN date_trunc('year', d) END AS DATE)::VARCHAR AS published,
         CAST(CASE WHEN k = 5 THEN DATE '2031-01-01' END AS DATE)::VARCHAR AS milestone FROM d""",
)
def free_dates(spark, sf_dir):
    """Days that texts state in many forms: the freshest past one, and the last to come."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    said = (
        F.when(k == 0, F.concat(F.lit("filed "), F.date_format(d, "yyyy-MM-dd"), F.lit(", not 1901-02-31, Suite 1998")))
        .when(k == 1, F.concat(F.lit("heard on "), F.date_format(d, "MMMM d, yyyy"), F.lit(" for $1999")))
        .when(k == 2, F.concat(F.date_format(d, "d"), F.lit("th of "), F.date_format(d, "MMM"), F.lit("., "), F.date_format(d, "yyyy")))
        .when(k == 3, F.date_format(d, "MMMM yyyy"))
        .when(k == 4, F.concat(F.lit("budget of FY"), F.date_format(d, "yyyy"), F.lit(" (FY1901)")))
        .otherwise("Vision 2030, opening in 2031")
    )
    today = F.lit("2026-01-01").cast("date")
    return read_spread(spark, sf_dir, "orders").select("o_orderkey", said.alias("said")).select("o_orderkey", D.date_candidates("said").alias("days")).select(
        "o_orderkey", D.last_day("days", lambda d: d <= today).cast("string").alias("published"), D.last_day("days", lambda d: d > today).cast("string").alias("milestone")
    )


@query(
    "derived_dates",
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'source' WHEN 1 THEN 'source' WHEN 2 THEN 'parsed' ELSE 'first_seen' END AS source,
         CASE l_linenumber % 4 WHEN 0 THEN CAST(l_shipdate AS DATE) WHEN 2 THEN CAST(date_trunc('year', l_shipdate) AS DATE) END::VARCHAR AS published,
         CASE l_linenumber % 4 WHEN 1 THEN CAST(l_shipdate AS DATE) END::VARCHAR AS deadline FROM lineitem""",
)
def derived_dates(spark, sf_dir):
    """Where a record's dates come from: its source, its text, or nowhere."""
    k, day = F.col("l_linenumber") % 4, F.date_format("l_shipdate", "yyyy-MM-dd")
    rows = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(k == 1, day).when(k == 2, "soon").alias("due"), F.when(k == 0, day).alias("said"),
        F.when(k == 2, F.concat(F.lit("Master plan of "), F.date_format("l_shipdate", "yyyy"))).otherwise("nothing dated").alias("text"),
    )
    found = D.derived_dates("due", "said", "text", F.lit("2026-01-01").cast("date"))
    return rows.select("l_orderkey", "l_linenumber", found.alias("d")).select("l_orderkey", "l_linenumber", "d.source", F.col("d.published").cast("string").alias("published"), F.col("d.deadline").cast("string").alias("deadline"))


@query(
    "opportunity_states",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'archive' WHEN d >= DATE '1997-01-01' THEN 'live' WHEN d < DATE '1995-01-01' AND o_orderkey % 3 <> 0 THEN 'delete' ELSE 'archive' END AS state
       FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)""",
)
def opportunity_states(spark, sf_dir):
    """Live, archived or purged, by deadline and milestone."""
    rows = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("deadline"), F.when(F.col("o_orderkey") % 3 == 0, "1999-05-01").alias("milestone")
    )
    day = lambda x: F.lit(x).cast("date")
    return rows.select("o_orderkey", D.opportunity_state("deadline", "milestone", day("1997-01-01"), day("1995-01-01")).alias("state"))
