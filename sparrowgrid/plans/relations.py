"""Join queries: semi-joins, scopes, relation walks, dictionaries."""

from pyspark.sql import functions as F

from sparrowgrid.functions import text as X
from sparrowgrid.operators import scopes as S
from sparrowgrid.plans.registry import query
from sparrowgrid.session import read


def _pair(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "key")
    return orders, read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "key")


@query("semi_stream", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1")
def semi_stream(spark, sf_dir):
    """Projects that hold a record of a stream."""
    orders, items = _pair(spark, sf_dir)
    return S.holding(orders, items, "key", F.col("l_returnflag") == "R").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(
    "semi_per_axis",
    """SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag IN ('R'))
       AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity IN (49, 50))""",
)
def semi_per_axis(spark, sf_dir):
    """Every axis is met by some record, not all by one."""
    orders, items = _pair(spark, sf_dir)
    return S.per_axis(orders, items, "key", {"l_returnflag": ["R"], "l_quantity": [49.0, 50.0], "l_linestatus": []}).select(F.col("key").alias("o_orderkey"))


@query("semi_same_row_contrast", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity IN (49, 50))")
def semi_same_row_contrast(spark, sf_dir):
    """All axes met by one record: fewer than ``semi_per_axis``."""
    orders, items = _pair(spark, sf_dir)
    return S.holding(orders, items, "key", (F.col("l_returnflag") == "R") & F.col("l_quantity").isin(49.0, 50.0)).select(F.col("key").alias("o_orderkey"))


_MEMBERS = "(SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'included' ELSE 'proposed' END AS status FROM orders WHERE o_orderstatus = 'F')"


def _members(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return rows.select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 3 == 0, "included").otherwise("proposed").alias("status"))


@query("membership_gate", f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM {_MEMBERS} WHERE status = 'included')")
def membership_gate(spark, sf_dir):
    """Only what a person confirmed."""
    return S.included(read(spark, sf_dir, "customer"), _members(spark, sf_dir), "c_custkey")[0].select("c_custkey", "c_name")


@query("anti_unconfirmed", f"SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM {_MEMBERS})")
def anti_unconfirmed(spark, sf_dir):
    """What has no membership at all."""
    return S.included(read(spark, sf_dir, "customer"), _members(spark, sf_dir), "c_custkey")[1].select("c_custkey", "c_name")


@query(
    "matched_axes",
    """SELECT o_orderkey, coalesce((SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM (
         SELECT 'l_returnflag:r' AS x FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R'
         UNION ALL SELECT 'l_linestatus:f' FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')), '') AS matched FROM orders""",
)
def matched_axes(spark, sf_dir):
    """Why a project matched a scope."""
    orders, items = _pair(spark, sf_dir)
    out = S.matched_axes(orders, items, "key", {"l_returnflag": ["R"], "l_linestatus": ["F"]})
    return out.select(F.col("key").alias("o_orderkey"), F.array_join("matched", ",").alias("matched"))


@query(
    "related_suppliers_shared",
    """WITH e AS (SELECT l_suppkey, l_partkey, count(*) AS w FROM lineitem GROUP BY 1, 2)
       SELECT a.l_suppkey, b.l_suppkey AS other, count(*) AS shared, CAST(sum(b.w) AS BIGINT) AS links
       FROM e a JOIN e b ON a.l_partkey = b.l_partkey AND a.l_suppkey <> b.l_suppkey GROUP BY 1, 2""",
)
def related_suppliers_shared(spark, sf_dir):
    """Two-hop neighbours with the number of shared projects and of link rows."""
    return S.related(read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey")


@query(
    "related_reasons",
    """WITH e AS (SELECT DISTINCT s_nationkey AS nation, s_suppkey FROM supplier), p AS (
         SELECT a.s_suppkey, b.s_suppkey AS other, 'nation' AS reason FROM e a JOIN e b ON a.nation = b.nation AND a.s_suppkey <> b.s_suppkey
         UNION SELECT a.s_suppkey, b.s_suppkey, 'rank' FROM supplier a JOIN supplier b ON CAST(floor(a.s_acctbal / 500) AS BIGINT) = CAST(floor(b.s_acctbal / 500) AS BIGINT) AND a.s_suppkey <> b.s_suppkey)
       SELECT s_suppkey, other, string_agg(reason, ',' ORDER BY reason) AS reasons FROM p GROUP BY 1, 2""",
)
def related_reasons(spark, sf_dir):
    """Related by one of two reasons, reasons gathered."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("nation"), F.floor(F.col("s_acctbal") / 500).alias("rank"))
    return S.related_by(s, "s_suppkey", ("nation", "rank"))


@query(
    "party_history",
    """WITH e AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem), n AS (SELECT l_suppkey, l_orderkey, count(*) OVER s AS n, min(l_orderkey) OVER s AS a,
         nth_value(l_orderkey, 2) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b FROM e WINDOW s AS (PARTITION BY l_suppkey))
       SELECT l_orderkey AS project, l_suppkey, n - 1 AS others, CASE WHEN l_orderkey = a THEN b ELSE a END AS first_other FROM n WHERE n > 1""",
)
def party_history(spark, sf_dir):
    """The other projects of a project's parties, for every project."""
    return S.history(read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "project"), "project", "l_suppkey")


@query(
    "players",
    """SELECT s_suppkey, count(DISTINCT l_orderkey) AS projects, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), '') AS roles,
       coalesce(bool_or(l_quantity > 45), false) AS reachable FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_linestatus = 'F' GROUP BY 1""",
)
def players(spark, sf_dir):
    """Companies with their projects, roles and reach; those without projects stay."""
    items = read(spark, sf_dir, "lineitem").where("l_linestatus = 'F'")
    by = items.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.countDistinct("l_orderkey").alias("projects"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("roles"), F.bool_or(F.col("l_quantity") > 45).alias("reachable")
    )
    return read(spark, sf_dir, "supplier").select("s_suppkey").join(by, "s_suppkey", "left").select(
        "s_suppkey", F.coalesce("projects", F.lit(0)).alias("projects"), F.coalesce("roles", F.lit("")).alias("roles"), F.coalesce("reachable", F.lit(False)).alias("reachable")
    )


_NORM = "regexp_replace(lower({}), '[^0-9]', '', 'g')"


@query(
    "normalised_key_match",
    f"""SELECT c_custkey, s_suppkey, least(100, CAST(c_custkey % 95 AS BIGINT) + 20) AS score FROM customer JOIN supplier
        ON {_NORM.format("c_name")} = {_NORM.format("s_name")}""",
)
def normalised_key_match(spark, sf_dir):
    """Registry against tenders on normalised names: a match lifts the score, up to 100."""
    digits = lambda c: F.regexp_replace(X.company_key(c), "[^0-9]", "")
    c = read(spark, sf_dir, "customer").select("c_custkey", digits("c_name").alias("k"))
    s = read(spark, sf_dir, "supplier").select("s_suppkey", digits("s_name").alias("k"))
    return c.join(s, "k").select("c_custkey", "s_suppkey", F.least(F.lit(100).cast("long"), F.col("c_custkey") % 95 + 20).alias("score"))


@query(
    "cross_source_anti",
    """SELECT count(*) AS n FROM part p WHERE p_size > 25 AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_size <= 25 AND lower(q.p_name) = lower(p.p_name) AND q.p_brand = p.p_brand)""",
)
def cross_source_anti(spark, sf_dir):
    """Rows of one source that the other doesn't have under the same title and company."""
    part = read(spark, sf_dir, "part").withColumn("title", F.lower("p_name"))
    return part.where("p_size > 25").join(part.where("p_size <= 25").select("title", "p_brand"), ["title", "p_brand"], "left_anti").agg(F.count("*").alias("n"))


@query(
    "group_has_both",
    """SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R') AND bool_or(l_returnflag <> 'R')""",
)
def group_has_both(spark, sf_dir):
    """Companies with a row in both lanes."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.bool_or(F.col("l_returnflag") != "R").alias("b"))
    return rows.where("a and b").select("l_partkey", "n")


@query(
    "milestone_lookup",
    """SELECT o_orderkey, CAST(max(l_shipdate) AS DATE)::VARCHAR AS latest, CAST(min(l_shipdate) FILTER (WHERE l_shipdate > TIMESTAMP '2000-01-01') AS DATE)::VARCHAR AS next_date,
       count(l_orderkey) > 0 AS there FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)
def milestone_lookup(spark, sf_dir):
    """Projects with aggregates of their milestones, and whether they have any."""
    future = F.when(F.col("l_shipdate") > F.lit("2000-01-01").cast("timestamp_ntz"), F.col("l_shipdate"))
    by = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").cast("date").cast("string").alias("latest"), F.min(future).cast("date").cast("string").alias("next_date"), F.lit(True).alias("there"))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(by, "o_orderkey", "left").select("o_orderkey", "latest", "next_date", F.coalesce("there", F.lit(False)).alias("there"))


@query(
    "dictionary_hits",
    """WITH t(term, target) AS (VALUES ('widget', 'w'), ('red', 'colour'), ('ring', 'r'))
       SELECT p_partkey, string_agg(target, ',' ORDER BY target) AS targets FROM part JOIN t ON regexp_matches(p_name, '(?i)\\b' || term || '\\b') GROUP BY 1""",
)
def dictionary_hits(spark, sf_dir):
    """Which watched terms stand in a text as whole words; the terms are a short list, so they are expressions and not a join."""
    from sparrowgrid.functions.predicates import whole_word

    terms = {"widget": "w", "red": "colour", "ring": "r"}
    hits = F.array_compact(F.array(*[F.when(whole_word("p_name", t), F.lit(v)) for t, v in terms.items()]))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.sort_array(hits), ",").alias("targets")).where("targets <> ''")


@query(
    "embedded_left_join",
    """SELECT event_id, event_type, c_name, o_totalprice FROM events LEFT JOIN customer ON c_custkey = user_id
       LEFT JOIN orders ON o_orderkey = event_id AND o_custkey % 2 = 0""",
)
def embedded_left_join(spark, sf_dir):
    """Events with their project and record, where there are any."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    o = read(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("event_id"), "o_totalprice")
    return e.join(c, "user_id", "left").join(o, "event_id", "left").select("event_id", "event_type", "c_name", "o_totalprice")


@query(
    "repoint_on_merge",
    """SELECT DISTINCT CASE WHEN l_suppkey % 2 = 1 THEN l_suppkey - 1 ELSE l_suppkey END AS l_suppkey, l_partkey FROM lineitem""",
)
def repoint_on_merge(spark, sf_dir):
    """Edges after every odd company is merged into the one before it."""
    items = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    merges = items.select("l_suppkey").distinct().where("l_suppkey % 2 = 1").select(F.col("l_suppkey").alias("loser"), (F.col("l_suppkey") - 1).alias("winner"))
    return S.repoint(items, merges, "l_suppkey", ["l_partkey"])


@query(
    "created_or_attached",
    """WITH w AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11' GROUP BY 1, 2)
       SELECT user_id, CAST(sum(n) AS BIGINT) AS attached FROM w WHERE user_id NOT IN (SELECT user_id FROM w WHERE event_type = 'signup') GROUP BY 1""",
)
def created_or_attached(spark, sf_dir):
    """Groups of attached records whose project was not created in the same window."""
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    e = read(spark, sf_dir, "events").where((F.col("ts") >= at("2024-01-10")) & (F.col("ts") < at("2024-01-11")))
    return e.join(e.where("event_type = 'signup'").select("user_id"), "user_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("attached"))
