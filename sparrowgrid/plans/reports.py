"""Report and period queries: windows of time, exclusion ladders, sections."""

from datetime import date, datetime

from pyspark.sql import functions as F

from sparrowgrid.functions import periods
from sparrowgrid.operators import ranking as K
from sparrowgrid.operators import register as R
from sparrowgrid.plans.registry import query
from sparrowgrid.session import read

NOW = datetime(2024, 1, 18, 12)


@query(
    "period_half_open",
    """SELECT 'this-week' AS period, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' UNION ALL SELECT 'm:2024-01', count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'
       UNION ALL SELECT '7d', count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-11 12:00:00' UNION ALL SELECT 'c:2024-01-03..2024-01-05', count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-06'""",
)
def period_half_open(spark, sf_dir):
    """Counts of named periods, in one pass."""
    tokens = ("this-week", "m:2024-01", "7d", "c:2024-01-03..2024-01-05")
    ts = F.col("ts").cast("timestamp")
    one = read(spark, sf_dir, "events").agg(*[F.count_if(periods.resolve(t, NOW).holds(ts)).alias(f"n{k}") for k, t in enumerate(tokens)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(t).alias("period"), F.col(f"n{k}").alias("n")) for k, t in enumerate(tokens)])))


@query(
    "weeks_in_month",
    """WITH m AS (SELECT unnest(range(DATE '2024-01-01', DATE '2024-02-01', INTERVAL 7 DAY)) AS monday)
       SELECT CAST(greatest(monday, TIMESTAMP '2024-01-01') AS DATE)::VARCHAR AS start_day, CAST(least(monday + INTERVAL 7 DAY, TIMESTAMP '2024-02-01') AS DATE)::VARCHAR AS end_day,
         (SELECT count(*) FROM events WHERE ts >= greatest(monday, TIMESTAMP '2024-01-01') AND ts < least(monday + INTERVAL 7 DAY, TIMESTAMP '2024-02-01')) AS n FROM m""",
)
def weeks_in_month(spark, sf_dir):
    """The weeks that tile a month, with their events."""
    month = (date(2024, 1, 1), date(2024, 2, 1))
    weeks = spark.range(1).select(F.inline(periods.weeks(*month))).select(F.col("start").alias("s"), F.col("end").alias("e"))
    counts = read(spark, sf_dir, "events").groupBy(periods.week_of("ts").alias("week")).agg(F.count("*").alias("n"))
    joined = weeks.join(counts, periods.week_of("s") == F.col("week"), "left")
    return joined.select(F.col("s").cast("string").alias("start_day"), F.col("e").cast("string").alias("end_day"), F.coalesce("n", F.lit(0)).alias("n"))


@query("bucket_month_week", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE)::VARCHAR AS month, CAST(date_trunc('week', o_orderdate) AS DATE)::VARCHAR AS week, count(*) AS n FROM orders GROUP BY 1, 2")
def bucket_month_week(spark, sf_dir):
    """Counts by month and ISO week."""
    return read(spark, sf_dir, "orders").groupBy(periods.month_of("o_orderdate").cast("string").alias("month"), periods.week_of("o_orderdate").cast("string").alias("week")).agg(F.count("*").alias("n"))


@query(
    "distinct_not_additive",
    """SELECT (SELECT count(DISTINCT user_id) FROM events) AS month_total, (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(DISTINCT user_id) AS n FROM events GROUP BY date_trunc('week', ts))) AS weeks_sum""",
)
def distinct_not_additive(spark, sf_dir):
    """Distinct counts of weeks don't add up to the month's."""
    pairs = read(spark, sf_dir, "events").select(periods.week_of("ts").alias("week"), "user_id").distinct()
    return pairs.agg(F.countDistinct("user_id").alias("month_total"), F.count("*").alias("weeks_sum"))


@query(
    "arrived_and_moved",
    """SELECT o_orderstatus, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-04-01')
       AND EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey AND ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15') GROUP BY 1""",
)
def arrived_and_moved(spark, sf_dir):
    """Projects with a record in one period and an event in another."""
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    items = read(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= at("1997-01-01")) & (F.col("l_shipdate") < at("1997-04-01"))).select(F.col("l_orderkey").alias("o_orderkey"))
    moved = read(spark, sf_dir, "events").where((F.col("ts") >= at("2024-01-08")) & (F.col("ts") < at("2024-01-15"))).select(F.col("user_id").alias("o_custkey"))
    return read(spark, sf_dir, "orders").join(items, "o_orderkey", "left_semi").join(moved, "o_custkey", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


_STEPS = ["scope", "frozen", "dormant", "hollow", "membership"]
_TESTS = ["o_orderstatus IN ('F', 'O')", "o_orderpriority <> '5-LOW'", "o_orderdate >= TIMESTAMP '1996-01-01'", "n_records > 0", "o_custkey % 3 <> 0"]


@query(
    "report_exclusion_ladder",
    "WITH o AS (SELECT orders.*, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS n_records FROM orders), c AS (SELECT count(*) AS r0, "
    + ", ".join(f"count(*) FILTER (WHERE {' AND '.join(_TESTS[: k + 1])}) AS r{k + 1}" for k in range(5))
    + " FROM o) "
    + " UNION ALL ".join(f"SELECT {k + 1} AS rung, '{s}' AS name, r{k + 1} AS kept, r{k} - r{k + 1} AS removed FROM c" for k, s in enumerate(_STEPS)),
)
def report_exclusion_ladder(spark, sf_dir):
    """How many projects each exclusion of a report removes, in its order."""
    records = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_records"))
    rows = read(spark, sf_dir, "orders").join(records, "o_orderkey", "left").withColumn("n_records", F.coalesce("n_records", F.lit(0)))
    return R.predicate_ladder(rows, [(s, F.expr(t.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))) for s, t in zip(_STEPS, _TESTS, strict=True)])


@query(
    "section_hearings_tenders",
    """SELECT 'hearings' AS section, count(*) AS n, CAST(min(l_shipdate) AS DATE)::VARCHAR AS first_day FROM lineitem WHERE CAST(l_shipdate AS DATE) > DATE '2001-06-01'
       UNION ALL SELECT 'tenders', count(*), CAST(min(l_shipdate) AS DATE)::VARCHAR FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '2001-06-01' AND l_returnflag = 'R'""",
)
def section_hearings_tenders(spark, sf_dir):
    """Hearings are after today, tenders from today on and filings."""
    day, today = F.col("l_shipdate").cast("date"), F.lit("2001-06-01").cast("date")
    rows = read(spark, sf_dir, "lineitem").where(day >= today)
    sections = {"hearings": day > today, "tenders": F.col("l_returnflag") == "R"}
    one = rows.agg(*[F.struct(F.count_if(p).alias("n"), F.min(F.when(p, day)).cast("string").alias("first_day")).alias(s) for s, p in sections.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(s).alias("section"), F.col(f"{s}.n").alias("n"), F.col(f"{s}.first_day").alias("first_day")) for s in sections])))


@query(
    "section_moved",
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS advanced, count(*) FILTER (WHERE event_type = 'error') AS corrected FROM events
       WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-22' GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'purchase') > 0""",
)
def section_moved(spark, sf_dir):
    """Projects that moved in the week, with corrections counted apart."""
    ts = F.col("ts").cast("timestamp")
    rows = read(spark, sf_dir, "events").where(periods.resolve("c:2024-01-15..2024-01-21", NOW).holds(ts)).groupBy("user_id")
    return rows.agg(F.count_if(F.col("event_type") == "purchase").alias("advanced"), F.count_if(F.col("event_type") == "error").alias("corrected")).where("advanced > 0")


@query(
    "section_headlines",
    """WITH p AS (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 15),
         r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) AS k FROM lineitem)
       SELECT o_orderkey, o_totalprice, l_linenumber FROM p LEFT JOIN r ON l_orderkey = o_orderkey AND k = 1""",
)
def section_headlines(spark, sf_dir):
    """The fifteen most significant projects with their newest record."""
    top = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(15)
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", "l_linenumber", "l_partkey")
    newest = K.last_wins(items.join(top.select("o_orderkey"), "o_orderkey", "left_semi"), "o_orderkey", "l_shipdate", "l_linenumber", "l_partkey")
    return top.join(newest, "o_orderkey", "left").select("o_orderkey", "o_totalprice", "l_linenumber")


@query(
    "section_watchlist",
    """SELECT c_custkey, count(event_id) AS activity, count(event_id) = 0 AS quiet FROM customer LEFT JOIN events ON user_id = c_custkey AND event_type = 'click' WHERE c_mktsegment = 'BUILDING' GROUP BY 1""",
)
def section_watchlist(spark, sf_dir):
    """Watched projects with their activity; the quiet ones stay."""
    clicks = read(spark, sf_dir, "events").where("event_type = 'click'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("activity"))
    rows = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey").join(clicks, "c_custkey", "left")
    return rows.select("c_custkey", F.coalesce("activity", F.lit(0)).alias("activity"), F.col("activity").isNull().alias("quiet"))


@query(
    "limit_then_filter",
    """SELECT event_type, count(*) AS n FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500) WHERE user_id % 2 = 0 GROUP BY 1""",
)
def limit_then_filter(spark, sf_dir):
    """The newest five hundred events, then filtered: fewer than filtered first."""
    newest = read(spark, sf_dir, "events").select("ts", "event_id", "event_type", "user_id").orderBy(F.desc("ts"), F.desc("event_id")).limit(500)
    return newest.where(F.col("user_id") % 2 == 0).groupBy("event_type").agg(F.count("*").alias("n"))
