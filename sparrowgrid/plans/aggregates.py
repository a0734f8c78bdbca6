"""Aggregate queries: coverage, health, modes, ladders, intervals."""

from pyspark.sql import functions as F

from sparrowgrid.functions import rules
from sparrowgrid.operators import ranking as K
from sparrowgrid.operators import register as R
from sparrowgrid.plans.registry import query
from sparrowgrid.session import read

NOW = "TIMESTAMP '2024-01-31'"


def at(day: str):
    return F.lit(day).cast("timestamp_ntz")


@query(
    "coverage_by_nation",
    """SELECT n_name, count(o_orderkey) AS records, count(DISTINCT CASE WHEN o_orderstatus <> 'F' THEN o_custkey END) AS live_projects,
       count(DISTINCT CASE WHEN o_totalprice > 400000 THEN o_custkey END) AS naming, CAST(max(o_orderdate) AS DATE)::VARCHAR AS newest
       FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
)
def coverage_by_nation(spark, sf_dir):
    """Per market: records, distinct live projects, distinct projects naming a party, newest document."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    # orders shrink to a row a project before they meet the markets
    project = orders.groupBy("o_custkey").agg(
        F.count("*").alias("records"), F.bool_or(F.col("o_orderstatus") != "F").alias("live"), F.bool_or(F.col("o_totalprice") > 400000).alias("naming"), F.max("o_orderdate").alias("newest")
    )
    per = customer.join(project, "o_custkey").groupBy("n_nationkey").agg(
        F.sum("records").alias("records"), F.count_if("live").alias("live_projects"), F.count_if("naming").alias("naming"), F.max("newest").cast("date").cast("string").alias("newest")
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return nation.join(per, "n_nationkey", "left").select("n_name", zero("records"), zero("live_projects"), zero("naming"), "newest")


@query(
    "coverage_verdict",
    """WITH c AS (
         SELECT p_brand, count(l_orderkey) AS records, count(DISTINCT CASE WHEN l_linestatus = 'O' AND p_size > 40 THEN p_partkey END) AS projects,
           count(DISTINCT CASE WHEN l_linestatus = 'O' AND p_size > 45 THEN p_partkey END) AS named, date_diff('day', max(l_shipdate), TIMESTAMP '2001-11-30') AS days
         FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity < 3 GROUP BY 1)
       SELECT p_brand, records, projects, named, CASE WHEN p_brand = 'Brand#3' THEN 'dead' WHEN p_brand = 'Brand#4' THEN 'degraded' WHEN records = 0 THEN 'thin'
         WHEN days IS NULL THEN 'thin' WHEN days > 90 THEN 'stale' WHEN projects = 0 THEN 'thin' WHEN projects >= 3 AND named * 1.0 / projects < 0.5 THEN 'thin' ELSE 'live' END AS state FROM c""",
)
def coverage_verdict(spark, sf_dir):
    """The worst thing true of each market's coverage."""
    items = read(spark, sf_dir, "lineitem").where("l_quantity < 3").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linestatus", "l_shipdate")
    rows = read(spark, sf_dir, "part").join(items, "p_partkey", "left")
    open_ = F.col("l_linestatus") == "O"
    per = rows.groupBy("p_brand").agg(
        F.count("l_orderkey").alias("records"),
        F.countDistinct(F.when(open_ & (F.col("p_size") > 40), F.col("p_partkey"))).alias("projects"),
        F.countDistinct(F.when(open_ & (F.col("p_size") > 45), F.col("p_partkey"))).alias("named"),
        F.datediff(F.lit("2001-11-30").cast("date"), F.max("l_shipdate").cast("date")).alias("days"),
    )
    state = rules.coverage_state(F.col("p_brand") == "Brand#3", F.col("p_brand") == "Brand#4", F.col("records"), F.col("days"), F.col("projects"), F.col("named"))
    return per.select("p_brand", "records", "projects", "named", state.alias("state"))


@query("latest_run_per_unit", "SELECT user_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS run_at FROM events GROUP BY 1")
def latest_run_per_unit(spark, sf_dir):
    """The newest run of each unit."""
    last = K.last_wins(read(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id")
    return last.select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("run_at"))


_BASE = """SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS cents, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events"""


def _baseline(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return K.capped(rows, "user_id", 5, F.desc("ts"), F.desc("event_id"))[0]


@query("baseline_last5", f"SELECT user_id, count(*) AS runs, CAST(sum(cents) AS BIGINT) AS cents FROM ({_BASE}) WHERE r <= 5 GROUP BY 1")
def baseline_last5(spark, sf_dir):
    """The last five runs of each unit, to compare the next with."""
    return _baseline(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("runs"), F.sum("cents").alias("cents"))


@query(
    "health_verdict",
    f"""WITH b AS (SELECT user_id, max(CASE WHEN r = 1 THEN cents END) AS latest, CAST(sum(CASE WHEN r > 1 THEN cents ELSE 0 END) AS BIGINT) AS before FROM ({_BASE}) WHERE r <= 5 GROUP BY 1)
        SELECT user_id, CASE WHEN latest IS NULL THEN 'no-fetch' WHEN latest >= 500 THEN 'ok' WHEN before > 0 THEN 'zero-kept' ELSE 'zero-no-baseline' END AS verdict FROM b""",
)
def health_verdict(spark, sf_dir):
    """How a unit's newest run compares with those before it."""
    per = _baseline(spark, sf_dir).groupBy("user_id").agg(F.max(F.when(F.col("rank") == 1, F.col("cents"))).alias("latest"), F.sum(F.when(F.col("rank") > 1, F.col("cents")).otherwise(0)).alias("before"))
    verdict = rules.first_match([(F.col("latest").isNull(), "no-fetch"), (F.col("latest") >= 500, "ok"), (F.col("before") > 0, "zero-kept")], "zero-no-baseline")
    return per.select("user_id", verdict.alias("verdict"))


@query("source_silence", f"SELECT event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, date_diff('day', max(ts), {NOW}) AS days_silent, count(*) AS n FROM events GROUP BY 1")
def source_silence(spark, sf_dir):
    """When each source was last heard."""
    days = F.datediff(F.lit("2024-01-31").cast("date"), F.max("ts").cast("date")).cast("long")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"), days.alias("days_silent"), F.count("*").alias("n"))


@query(
    "mode_first_seen",
    """WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1, 2)
       SELECT o_custkey, arg_max(o_orderpriority, struct_pack(a := n, b := -first)) AS mode, max(n) AS n FROM c GROUP BY 1""",
)
def mode_first_seen(spark, sf_dir):
    """The most frequent value, ties to the first seen."""
    return K.mode_first_seen(read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


@query(
    "recount_drift",
    """SELECT o_orderkey, stored, live FROM (SELECT o_orderkey, o_custkey % 7 AS stored, count(l_orderkey) AS live FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
       WHERE stored <> live""",
)
def recount_drift(spark, sf_dir):
    """Stored counters that differ from the live count."""
    live = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("live"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 7).alias("stored")).join(live, "o_orderkey", "left")
    return rows.withColumn("live", F.coalesce("live", F.lit(0).cast("long"))).where("stored <> live")


_RUNGS = ("o_orderstatus <> 'P'", "o_orderdate >= timestamp '1997-01-01'", "o_totalprice > 250000", "o_orderpriority <> 'none'")


@query(
    "predicate_ladder",
    "WITH c AS (SELECT count(*) AS r0, "
    + ", ".join(f"count(*) FILTER (WHERE {' AND '.join(_RUNGS[: k + 1])}) AS r{k + 1}" for k in range(4))
    + " FROM orders) "
    + " UNION ALL ".join(f"SELECT {k} AS rung, 'clause{k}' AS name, r{k} AS kept, r{k - 1} - r{k} AS removed FROM c" for k in range(1, 5)),
)
def predicate_ladder(spark, sf_dir):
    """How many rows each further clause removes; one pass."""
    return R.predicate_ladder(read(spark, sf_dir, "orders"), [(f"clause{k}", F.expr(p.replace("timestamp '", "timestamp_ntz '"))) for k, p in enumerate(_RUNGS, 1)])


@query(
    "conditional_counts",
    """SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_totalprice > 300000) AS large,
       count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F') AS parties, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS cents FROM orders""",
)
def conditional_counts(spark, sf_dir):
    """Summary figures of a screen in one pass."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return read(spark, sf_dir, "orders").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("o_orderstatus") == "O").alias("open"),
        F.count_if(F.col("o_totalprice") > 300000).alias("large"),
        F.countDistinct(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))).alias("parties"),
        F.sum(F.when(F.col("o_orderstatus") == "O", cents).otherwise(0)).alias("cents"),
    )


@query(
    "wilson_interval",
    """WITH c AS (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS hits, count(*) AS n FROM orders GROUP BY 1),
         p AS (SELECT *, hits * 1.0::DOUBLE / n AS p FROM c)
       SELECT o_orderpriority, hits, n, round(greatest(0, (p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS low,
         round(least(1, (p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS high FROM p""",
)
def wilson_interval(spark, sf_dir):
    """Rates with their Wilson intervals."""
    per = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("hits"), F.count("*").alias("n"))
    low, high = R.wilson(F.col("hits"), F.col("n"))
    return per.select("o_orderpriority", "hits", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(
    "gate_precision_recall",
    """WITH l AS (SELECT d.doc_id, quality = 1 AS relevant, n_chars >= 300 AS admitted FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
       SELECT count(*) FILTER (WHERE admitted AND relevant) AS tp, count(*) FILTER (WHERE admitted AND NOT relevant) AS fp, count(*) FILTER (WHERE NOT admitted AND relevant) AS fn,
         round(count(*) FILTER (WHERE admitted AND relevant) * 1.0 / count(*) FILTER (WHERE admitted), 6) AS precision,
         round(count(*) FILTER (WHERE admitted AND relevant) * 1.0 / count(*) FILTER (WHERE relevant), 6) AS recall FROM l""",
)
def gate_precision_recall(spark, sf_dir):
    """A gate against its labels."""
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 300).alias("admitted")).join(read(spark, sf_dir, "labels"), "doc_id")
    good, adm = F.col("quality") == 1, F.col("admitted")
    one = rows.agg(F.count_if(adm & good).alias("tp"), F.count_if(adm & ~good).alias("fp"), F.count_if(~adm & good).alias("fn"))
    return one.select("*", F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.col("tp") / (F.col("tp") + F.col("fn")), 6).alias("recall"))


@query(
    "category_place_remainder",
    """SELECT o_orderpriority AS category, n_name AS place, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
)
def category_place_remainder(spark, sf_dir):
    """Counts by category and place."""
    place = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("place"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), "o_custkey").groupBy("category", "o_custkey").agg(F.count("*").alias("n"))
    return rows.join(place, "o_custkey").groupBy("category", "place").agg(F.sum("n").alias("n"))


@query(
    "term_variant_lift",
    """WITH t(term) AS (VALUES ('red'), ('ring'), ('widget')), h AS (SELECT term, p_size > 25 AS large, p_type = 'PROMO' AS promo FROM part JOIN t ON contains(p_name, term))
       SELECT term, 'all' AS variant, count(*) AS hits FROM h GROUP BY 1 UNION ALL SELECT term, 'large', count(*) FROM h WHERE large GROUP BY 1 UNION ALL SELECT term, 'promo', count(*) FROM h WHERE promo GROUP BY 1""",
)
def term_variant_lift(spark, sf_dir):
    """Hits of candidate terms under variants of the predicate, in one pass."""
    rows = read(spark, sf_dir, "part")
    variants = {"all": F.lit(True), "large": F.col("p_size") > 25, "promo": F.col("p_type") == "PROMO"}
    told = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(v).alias("variant"), (F.col("p_name").contains(t) & p).alias("hit")) for t in ("red", "ring", "widget") for v, p in variants.items()])
    return rows.select(F.inline(told)).where("hit").groupBy("term", "variant").agg(F.count("*").alias("hits"))


@query(
    "facts_per_project",
    """SELECT l_orderkey, count(*) FILTER (WHERE l_quantity > 10) AS facts, count(DISTINCT l_partkey) FILTER (WHERE l_quantity > 10) AS kinds FROM lineitem GROUP BY 1""",
)
def facts_per_project(spark, sf_dir):
    """Quotable facts of each project."""
    good = F.col("l_quantity") > 10
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(good).alias("facts"), F.countDistinct(F.when(good, F.col("l_partkey"))).alias("kinds"))
