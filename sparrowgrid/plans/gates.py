"""Queries on the register's vocabulary: venues, the whole admission gate, gate decisions, categories and views."""

from pyspark.sql import functions as F

from sparrowgrid.functions import dates as D
from sparrowgrid.functions import taxonomy as T
from sparrowgrid.functions.predicates import any_word
from sparrowgrid.operators import gates as G
from sparrowgrid.operators.dictionary import first_known_code
from sparrowgrid.plans.places import _sql
from sparrowgrid.plans.registry import query
from sparrowgrid.session import read, read_spread

# Texts of filings, the market, the venue type and the gate's reason.
FILINGS = [
    ("A new theme park with a water park", None, "Waterpark", "strong"),
    ("Expansion of SeaWorld", None, "Theme Park", "no-match"),
    ("Hotel, conditional use permit", None, "Hotel", "weak+action"),
    ("Hotel tax note", None, "Hotel", "weak-without-action"),
    ("Closed session on a casino", None, "Casino/Gaming", "excluded"),
    ("Notice of Planning Commission meeting to hear a hotel rezoning", None, "Hotel", "governance-instrument"),
    ("Amending the budget for road works", None, None, "governance-instrument"),
    ("Amending the budget for an ice arena", None, "Arena/Stadium", "strong"),
    ("Levying taxes for the year", None, None, "governance-instrument"),
    ("Zoning for a data centre and a hotel", None, "Hotel", "out-of-vertical"),
    ("Mixed-use rezoning with 240 residential units", None, "Mixed-Use Development", "residential-mixed-use"),
    ("Mixed use rezoning near the station", None, "Mixed-Use Development", "weak+action"),
    ("Mixed use rezoning near the station", "New York City", "Mixed-Use Development", "residential-mixed-use"),
    ("A development agreement for the mill site", None, None, "deal"),
    ("A development agreement for single-family lots", None, None, "deal-detached-residential"),
    ("Rezoning from resort commercial to office", None, None, "no-match"),
    ("The Las Vegas Downtown Redevelopment Plan lists a lodge", None, "Hotel", "strong"),
    ("Pave the street", None, None, "no-match"),
    ("The water-park and the transit oriented village", None, "Waterpark", "strong"),
    ("", None, None, "no-match"),
    (None, None, None, "no-match"),
]
EXCLUDED, OUTSIDE = ("closed session", "proclamation"), ("data centre", "warehouse")


def _filings(spark, sf_dir):
    k = (F.col("c_custkey") % len(FILINGS)).cast("int")
    at = lambda i: F.get(F.array(*[F.lit(x[i]).cast("string") for x in FILINGS]), k)
    return read_spread(spark, sf_dir, "customer").select("c_custkey", at(0).alias("said"), at(1).alias("market"))


def _expected(i: int, name: str) -> str:
    return "(VALUES " + ", ".join(f"({k}, {_sql(x[i])})" for k, x in enumerate(FILINGS)) + f") v(k, {name})"


@query("venue_types", f"SELECT c_custkey, v.venue FROM customer JOIN {_expected(2, 'venue')} ON c_custkey % {len(FILINGS)} = v.k")
def venue_types(spark, sf_dir):
    """The venue type of every filing."""
    return _filings(spark, sf_dir).select("c_custkey", T.venue_type("said").alias("venue"))


@query(
    "admission_reasons",
    f"SELECT c_custkey, v.reason, v.reason IN ('strong', 'weak+action', 'deal') AS matched FROM customer JOIN {_expected(3, 'reason')} ON c_custkey % {len(FILINGS)} = v.k",
)
def admission_reasons(spark, sf_dir):
    """The gate's verdict on every filing, with all its rungs."""
    gate = T.register_gate("said", "market", EXCLUDED, OUTSIDE)
    return _filings(spark, sf_dir).select("c_custkey", gate.alias("g")).select("c_custkey", "g.reason", "g.matched")


@query(
    "gate_decisions",
    f"""WITH f AS (SELECT c_custkey, v.reason, c_custkey % 4 AS s, c_custkey % 3 = 0 AS strong, c_custkey % 2 = 0 AS known, c_custkey % 5 = 0 AS single FROM customer JOIN {_expected(3, 'reason')} ON c_custkey % {len(FILINGS)} = v.k),
         d AS (SELECT *, CASE WHEN reason IN ('strong', 'weak+action', 'deal') THEN reason WHEN reason NOT IN ('excluded', 'governance-instrument') AND (s = 0 OR s = 1 AND strong) THEN 'bypass'
           WHEN reason NOT IN ('excluded', 'governance-instrument') AND known AND reason <> 'deal-detached-residential' THEN 'known-entity' WHEN single THEN 'single-purpose' END AS way FROM f)
       SELECT c_custkey, way IS NOT NULL AS admitted, coalesce(way, reason) AS reason FROM d""",
)
def gate_decisions(spark, sf_dir):
    """The decision on every filing: the gate, the watch list as its source may use it, known entities, single-purpose sources."""
    gate = T.register_gate("said", "market", EXCLUDED, OUTSIDE)
    c = F.col("c_custkey")
    source = F.when(c % 4 == 0, "legistar").when(c % 4 == 1, "cftod-pdf").otherwise("press")
    rows = _filings(spark, sf_dir).select("c_custkey", "said", gate.alias("g"), source.alias("source"))
    made = T.decision(F.col("g.reason"), F.col("g.matched"), F.col("source"), c % 3 == 0, F.lit(True), F.when(c % 2 == 0, "a firm"), F.coalesce(T.is_detached_residential("said"), F.lit(False)), c % 5 == 0)
    return rows.select("c_custkey", made.alias("d")).select("c_custkey", "d.admitted", "d.reason")


def _candidates(spark, sf_dir):
    """Filings that name parts' firms, streets or nothing, in the nations of customers; parts are watched, suppliers' firms known."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    n = part.count()
    c = F.col("c_custkey")
    name = lambda key: part.select(F.col("p_partkey").alias(f"k{key}"), F.col("p_name").alias(f"name{key}"))
    filed = _filings(spark, sf_dir).join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    filed = filed.join(name(1), c % n == F.col("k1")).join(name(2), c * 7 % n == F.col("k2"))
    tail = F.when(c % 3 == 0, F.concat(F.lit(" filed by "), F.initcap("name1"), F.lit(" River, LLC"))).when(c % 3 == 1, F.concat(F.lit(" works on "), "name1", F.lit(" river road"))).otherwise(" and nothing more")
    said = F.concat(F.coalesce("said", F.lit("")), tail)
    rows = filed.select(
        c.alias("id"), F.when(c % 4 == 0, "legistar").when(c % 4 == 1, "cftod-pdf").otherwise("press").alias("source"), F.col("n_name").alias("market"), said.alias("said"),
        F.when(c % 2 == 0, F.concat(said, F.lit(" near "), "name2")).alias("wide"), (c % 5 == 0).alias("single_purpose"), F.col("market").alias("scaled"),
    )
    size = F.col("p_size")
    watched = part.where(size < 6).select(F.initcap("p_name").alias("term"), (size % 2 == 0).alias("strong"), (size == 1).alias("weak_alone"))
    supplier = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(part, F.col("s_suppkey") % n == F.col("p_partkey"))
    return rows, watched, supplier.select(F.col("n_name").alias("market"), F.concat("p_name", F.lit(" river")).alias("entity"), F.col("s_suppkey").alias("place"))


@query(
    "gate_decisions_joined",
    f"""WITH w AS (SELECT p_name, bool_or(p_size % 2 = 0) AS strong FROM part WHERE p_size BETWEEN 2 AND 5 GROUP BY 1),
         e AS (SELECT DISTINCT s_nationkey AS m, p_name FROM (SELECT *, s_suppkey % (SELECT count(*) FROM part) AS k FROM supplier) JOIN part ON p_partkey = k),
         f AS (SELECT c_custkey AS id, c_nationkey AS m, v.reason, c_custkey % 4 AS s, c_custkey % 5 = 0 AS single, c_custkey % 3 AS t, c_custkey % 2 = 0 AS wide, a.p_name AS n1, b.p_name AS n2
           FROM (SELECT *, c_custkey % (SELECT count(*) FROM part) AS k1, c_custkey * 7 % (SELECT count(*) FROM part) AS k2 FROM customer)
             JOIN {_expected(3, 'reason')} ON c_custkey % {len(FILINGS)} = v.k JOIN part a ON a.p_partkey = k1 JOIN part b ON b.p_partkey = k2),
         g AS (SELECT f.*, a.p_name IS NOT NULL OR b.p_name IS NOT NULL AS watched, coalesce(a.strong, FALSE) OR coalesce(b.strong, FALSE) AS strong, e.p_name AS known FROM f
           LEFT JOIN w a ON t < 2 AND a.p_name = n1 LEFT JOIN w b ON wide AND b.p_name = n2 LEFT JOIN e ON t = 0 AND e.m = f.m AND e.p_name = n1),
         d AS (SELECT *, CASE WHEN reason IN ('strong', 'weak+action', 'deal') THEN reason WHEN reason NOT IN ('excluded', 'governance-instrument') AND (s = 0 AND watched OR s = 1 AND strong) THEN 'bypass'
           WHEN reason NOT IN ('excluded', 'governance-instrument') AND known IS NOT NULL AND reason <> 'deal-detached-residential' THEN 'known-entity' WHEN single THEN 'single-purpose' END AS way FROM g)
       SELECT id, way IS NOT NULL AS admitted, coalesce(way, reason) AS reason, CASE WHEN way = 'known-entity' THEN known || ' river' END AS entity FROM d""",
)
def gate_decisions_joined(spark, sf_dir):
    """The decision on every filing, watched terms and known entities coming from tables."""
    rows, watched, entities = _candidates(spark, sf_dir)
    return G.decide(rows, T.register_gate("said", "scaled", EXCLUDED, OUTSIDE), watched, entities).select("id", "admitted", "reason", "entity")


@query(
    "civic_subjects",
    """SELECT p_partkey, p_partkey % 5 IN (0, 2) AS civic, p_partkey % 5 = 4 AS broker FROM part""",
)
def civic_subjects(spark, sf_dir):
    """Institutions as the subject of a filing, not as a part or a neighbour; brokers' phrases."""
    said = F.element_at(
        F.array(*map(F.lit, ("An elementary school on Elm", "A mixed-use project including a public school", "For an existing church", "Baptist Church of X, applicant", "Exclusive listing, call now"))),
        (F.col("p_partkey") % 5 + 1).cast("int"),
    )
    return read(spark, sf_dir, "part").select("p_partkey", said.alias("said")).select("p_partkey", T.is_civic("said").alias("civic"), any_word("said", ("exclusive listing", "for sale by owner")).alias("broker"))


_LEADS = """l AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'fuel' WHEN '2-HIGH' THEN 'signals' WHEN '3-MEDIUM' THEN 'feasibility' END AS category,
    CASE o_orderkey % 4 WHEN 0 THEN 'fuel' WHEN 1 THEN 'general_consulting' WHEN 2 THEN 'food_beverage_hospitality' END AS module, CASE o_orderkey % 3 WHEN 0 THEN 'tender' WHEN 1 THEN 'registry' END AS lead_type,
    CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'expired' ELSE 'dead' END AS status, CAST(o_orderdate AS DATE) AS deadline,
    CASE o_orderkey % 5 WHEN 0 THEN 'semarnat' WHEN 1 THEN 'nepa_jm' ELSE 'other' END AS source, CASE o_custkey % 2 WHEN 0 THEN 'Cancun, Quintana Roo' ELSE 'Mexico' END AS location,
    CASE o_orderkey % 7 WHEN 0 THEN 'award_or_dead' ELSE 'rfp' END AS subcategory FROM orders)"""


def _leads(spark, sf_dir):
    k = lambda n: F.col("o_orderkey") % n
    p = F.col("o_orderpriority")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(p == "1-URGENT", "fuel").when(p == "2-HIGH", "signals").when(p == "3-MEDIUM", "feasibility").alias("category"),
        F.when(k(4) == 0, "fuel").when(k(4) == 1, "general_consulting").when(k(4) == 2, "food_beverage_hospitality").alias("module"),
        F.when(k(3) == 0, "tender").when(k(3) == 1, "registry").alias("lead_type"),
        F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "expired").otherwise("dead").alias("status"),
        F.col("o_orderdate").cast("date").alias("deadline"),
        F.when(k(5) == 0, "semarnat").when(k(5) == 1, "nepa_jm").otherwise("other").alias("source"),
        F.when(F.col("o_custkey") % 2 == 0, "Cancun, Quintana Roo").otherwise("Mexico").alias("location"),
        F.when(k(7) == 0, "award_or_dead").otherwise("rfp").alias("subcategory"),
    )


@query(
    "category_lists",
    f"""WITH {_LEADS}, a AS (SELECT *, status IN ('expired', 'dead') OR deadline < DATE '1998-01-01' OR subcategory = 'award_or_dead' AS archived FROM l),
         c AS (SELECT unnest(['all', 'fuel', 'consulting', 'feasibility', 'signals', 'tenders', 'hiring']) AS list),
         m AS (SELECT list, archived FROM c JOIN a ON CASE list WHEN 'all' THEN true WHEN 'fuel' THEN coalesce(category = 'fuel', module = 'fuel', false)
           WHEN 'consulting' THEN category IS NULL AND module IS NOT NULL AND module <> 'fuel' WHEN 'tenders' THEN lead_type = 'tender' WHEN 'hiring' THEN lead_type = 'registry' ELSE category = list END)
       SELECT list, count(*) FILTER (WHERE NOT archived) AS shown, count(*) FILTER (WHERE archived) AS archived FROM m GROUP BY 1""",
)
def category_lists(spark, sf_dir):
    """Every list's rows, shown and archived, in one pass."""
    lists = ("all", "fuel", "consulting", "feasibility", "signals", "tenders", "hiring")
    archived = T.is_archived(F.lit("1998-01-01").cast("date"))
    marks = F.array(*[F.when(T.in_category(k), F.lit(k)) for k in lists])
    rows = _leads(spark, sf_dir).select(F.explode(F.array_compact(marks)).alias("list"), archived.alias("old"))
    return rows.groupBy("list").agg(F.count_if(~F.col("old")).alias("shown"), F.count_if("old").alias("archived"))


@query(
    "jurisdictions_modules",
    f"""WITH {_LEADS}, m AS (SELECT 'MX' AS k, source = 'semarnat' AS hit FROM l UNION ALL SELECT 'JM', source = 'nepa_jm' FROM l UNION ALL SELECT 'quintana roo', source = 'semarnat' AND contains(lower(location), 'quintana roo') FROM l
         UNION ALL SELECT 'm:fuel', module = 'fuel' FROM l UNION ALL SELECT 'm:local', module = 'food_beverage_hospitality' FROM l UNION ALL SELECT 'm:hiring', lead_type = 'registry' FROM l)
       SELECT k, count(*) FILTER (WHERE hit) AS n FROM m GROUP BY 1""",
)
def jurisdictions_modules(spark, sf_dir):
    """Rows of jurisdictions (a country, a state named in the location) and of modules."""
    rules = {k: T.in_jurisdiction(k) for k in ("MX", "JM", "quintana roo")} | {f"m:{k}": T.in_module(k) for k in ("fuel", "local", "hiring")}
    one = _leads(spark, sf_dir).agg(*[F.count_if(p).alias(f"n{i}") for i, p in enumerate(rules.values())])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"n{i}").alias("n")) for i, k in enumerate(rules)])))


@query(
    "view_counts",
    """WITH p AS (SELECT CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'O' THEN 'dismissed' ELSE 'client_ready' END AS status, o_custkey % 3 = 0 AS watch, CAST(o_orderdate AS DATE) AS created FROM orders)
       SELECT 'trash' AS view, count(*) FILTER (WHERE status = 'dismissed') AS n FROM p UNION ALL SELECT 'watchlist', count(*) FILTER (WHERE status IS DISTINCT FROM 'dismissed' AND watch) FROM p
       UNION ALL SELECT 'all', count(*) FILTER (WHERE status IS DISTINCT FROM 'dismissed') FROM p UNION ALL SELECT 'new', count(*) FILTER (WHERE status IS DISTINCT FROM 'dismissed' AND created >= DATE '1997-12-25') FROM p
       UNION ALL SELECT 'client_ready', count(*) FILTER (WHERE status = 'client_ready') FROM p""",
)
def view_counts(spark, sf_dir):
    """How many rows each named view of the register holds."""
    s = F.col("o_orderstatus")
    rows = read(spark, sf_dir, "orders").select(
        F.when(s == "O", "dismissed").when(s == "F", "client_ready").alias("status"), (F.col("o_custkey") % 3 == 0).alias("watch"), F.col("o_orderdate").cast("date").alias("created")
    )
    views = ("trash", "watchlist", "all", "new", "client_ready")
    one = rows.agg(*[F.count_if(T.view_filter(v, F.lit("1998-01-01").cast("date"))).alias(v) for v in views])
    return one.select(F.inline(F.array(*[F.struct(F.lit(v).alias("view"), F.col(v).alias("n")) for v in views])))


@query(
    "tender_notices",
    """SELECT p_partkey, CASE WHEN p_size > 45 THEN 'award_or_dead' WHEN p_partkey % 3 = 0 THEN 'framework' WHEN p_partkey % 3 = 1 THEN 'rfp' ELSE 'solicitation' END AS notice,
       CASE WHEN p_partkey % 4 = 0 THEN '98341000,55100000' ELSE '' END AS codes FROM part""",
)
def tender_notices(spark, sf_dir):
    """Notice types of tenders, and the codes of their CPV lines."""
    from sparrowgrid.functions.facts import cpv_codes

    k = F.col("p_partkey") % 3
    said = F.concat(F.when(k == 0, "A framework agreement").when(k == 1, "RFP for works").otherwise("Works"), F.when(F.col("p_partkey") % 4 == 0, "\nCPV: 98341000-5, 55100000, 98341000").otherwise("\nCode 98341000"))
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_size", said.alias("said"))
    return rows.select("p_partkey", T.tender_notice("said", F.col("p_size") > 45).alias("notice"), F.array_join(cpv_codes("said"), ",").alias("codes"))


_LADDERS = {
    "fuel, any": T.CategoryFilter("fuel"),
    "fuel, dead": T.CategoryFilter("fuel", notice="award_or_dead"),
    "fuel, jet": T.CategoryFilter("fuel", product="jet", cargo=True),
    "consulting, other": T.CategoryFilter("consulting", sub="other", include_archived=True),
    "feasibility, south": T.CategoryFilter("feasibility", latam=True),
    "signals, permits": T.CategoryFilter("signals", signal_type="permit", jurisdiction="MX"),
    "tenders, health": T.CategoryFilter("tenders", industry="health"),
    "tenders, dead": T.CategoryFilter("tenders", notice="award_or_dead"),
}


@query(
    "category_ladders",
    f"""WITH {_LEADS}, x AS (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'jet' WHEN 1 THEN 'diesel' END AS product, o_custkey % 2 = 0 AS cargo, CASE WHEN o_custkey % 3 = 0 THEN 'LATAM_CARIB' END AS region,
           CASE o_custkey % 4 WHEN 0 THEN 'permit' WHEN 1 THEN 'plan' END AS kind, o_custkey % 5 = 0 AS health, status IN ('expired', 'dead') OR deadline < DATE '1998-01-01' OR subcategory = 'award_or_dead' AS old FROM l JOIN orders USING (o_orderkey)),
         m AS (SELECT o_orderkey, unnest([
           CASE WHEN coalesce(category = 'fuel', module = 'fuel', false) AND NOT old THEN 'fuel, any' END,
           CASE WHEN coalesce(category = 'fuel', module = 'fuel', false) AND subcategory = 'award_or_dead' THEN 'fuel, dead' END,
           CASE WHEN coalesce(category = 'fuel', module = 'fuel', false) AND NOT old AND cargo AND product = 'jet' THEN 'fuel, jet' END,
           CASE WHEN category = 'feasibility' AND NOT old AND region = 'LATAM_CARIB' THEN 'feasibility, south' END,
           CASE WHEN category = 'signals' AND NOT old AND kind = 'permit' AND source = 'semarnat' THEN 'signals, permits' END,
           CASE WHEN lead_type = 'tender' AND NOT old AND health THEN 'tenders, health' END,
           CASE WHEN lead_type = 'tender' AND old THEN 'tenders, dead' END]) AS list FROM x)
       SELECT list, count(*) AS n, sum(o_orderkey)::BIGINT AS ids FROM m WHERE list IS NOT NULL GROUP BY 1""",
)
def category_ladders(spark, sf_dir):
    """Lists of every category narrowed by its own ladder, in one pass."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    more = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 3 == 0, "jet").when(k % 3 == 1, "diesel").alias("product_type"), (c % 2 == 0).alias("is_cargo"), F.when(c % 3 == 0, "LATAM_CARIB").alias("region"),
        F.when(c % 4 == 0, "permit").when(c % 4 == 1, "plan").alias("signal_type"), F.when(c % 5 == 0, "health").otherwise("other").alias("industry"),
    )
    now = F.lit("1998-01-01").cast("date")
    notice = F.when(T.is_archived(now), "award_or_dead").otherwise("solicitation")
    marks = F.array_compact(F.array(*[F.when(f.predicate(now, notice, F.col("industry")), F.lit(n)) for n, f in _LADDERS.items()]))
    return _leads(spark, sf_dir).join(more, "o_orderkey").select("o_orderkey", F.explode(marks).alias("list")).groupBy("list").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids"))


@query(
    "code_industries",
    """WITH t AS (SELECT DISTINCT substr(lpad((l_partkey * 7919 % 100000000)::VARCHAR, 8, '0'), 1, 1 + (l_suppkey % 5)::INT) AS code FROM lineitem WHERE l_linenumber = 1),
         c AS (SELECT p_partkey, 1 AS place, lpad((p_partkey * 7919 % 100000000)::VARCHAR, 8, '0') AS code FROM part UNION ALL SELECT p_partkey, 2, lpad((p_size * 104729)::VARCHAR, 8, '9') FROM part),
         h AS (SELECT p_partkey, t.code, row_number() OVER (PARTITION BY p_partkey ORDER BY place, length(t.code) DESC) AS k FROM c JOIN t ON starts_with(c.code, t.code))
       SELECT p_partkey, 'industry of ' || code AS industry FROM h WHERE k = 1""",
)
def code_industries(spark, sf_dir):
    """The industry of every part's first known code, by the longest prefix in a tree of codes of one to five digits."""
    text = lambda c: F.lpad((F.col(c) * 7919 % 100_000_000).cast("string"), 8, "0")
    tree = read(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.substring(text("l_partkey"), F.lit(1), (F.col("l_suppkey") % 5 + 1).cast("int")).alias("code")).distinct()
    codes = F.array(text("p_partkey"), F.lpad((F.col("p_size") * 104729).cast("string"), 8, "9"))
    rows = read(spark, sf_dir, "part").select("p_partkey", codes.alias("codes"))
    return first_known_code(rows, "p_partkey", "codes", tree.withColumn("industry", F.concat(F.lit("industry of "), "code")), "code", "industry")


@query(
    "stated_times",
    """WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS k, o_custkey % 50 AS n, o_orderdate AS d FROM orders)
       SELECT o_orderkey, CASE k WHEN 5 THEN NULL WHEN 4 THEN d::DATE::VARCHAR ELSE (TIMESTAMP '2001-01-01 00:00:00' - to_seconds(n * CASE k WHEN 0 THEN 3600 WHEN 1 THEN 86400 WHEN 2 THEN 604800 ELSE 31536000 END))::DATE::VARCHAR END AS day FROM o""",
)
def stated_times(spark, sf_dir):
    """Days of press that says how old it is."""
    k, n = F.col("o_orderkey") % 6, (F.col("o_custkey") % 50).cast("string")
    said = F.when(k == 4, F.col("o_orderdate").cast("date").cast("string")).when(k == 5, "the other day").otherwise(F.concat(F.lit(" "), n, F.when(k == 0, " hours ago").when(k == 1, " Day ago").when(k == 2, " weeks  ago").otherwise(" years ago")))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", said.alias("said"))
    return rows.select("o_orderkey", D.stated_time("said", F.lit("2001-01-01 00:00:00").cast("timestamp")).cast("date").cast("string").alias("day"))
