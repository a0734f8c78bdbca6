"""Queries by rank: first wins, latest children, caps, samples, labels."""

from pyspark.sql import functions as F

from sparrowgrid.operators import ranking as K
from sparrowgrid.plans.registry import query
from sparrowgrid.session import read


@query("first_wins_dedupe", "SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS r FROM lineitem) WHERE r = 1")
def first_wins_dedupe(spark, sf_dir):
    """The first record of each url."""
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")
    return K.first_wins(rows, "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey").drop("l_suppkey")


@query(
    "latest_child",
    """SELECT l_orderkey, CAST(l_shipdate AS DATE)::VARCHAR AS day, l_linenumber FROM
       (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) AS r FROM lineitem) WHERE r = 1""",
)
def latest_child(spark, sf_dir):
    """The newest record of each project."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey")
    return K.last_wins(rows, "l_orderkey", "l_shipdate", "l_linenumber", "l_partkey").select("l_orderkey", F.col("l_shipdate").cast("date").cast("string").alias("day"), "l_linenumber")


@query(
    "ranked_detail_remainder",
    """WITH r AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rank, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
       SELECT o_orderstatus, o_orderkey, CAST(rank AS INTEGER) AS rank, n - 15 AS held FROM r WHERE rank <= 15""",
)
def ranked_detail_remainder(spark, sf_dir):
    """The top fifteen of each group, and how many are counted only."""
    rows, held = K.capped(read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice"), "o_orderstatus", 15, F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey"))
    return rows.join(held, "o_orderstatus").select("o_orderstatus", "o_orderkey", "rank", "held")


@query("group_weight_sort", "SELECT c_custkey, c_nationkey, count(*) OVER (PARTITION BY c_nationkey) AS weight FROM customer ORDER BY weight DESC, c_nationkey, c_custkey")
def group_weight_sort(spark, sf_dir):
    """Groups by size, then name, then member."""
    return K.group_weight(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey").select("c_custkey", "c_nationkey", "weight").orderBy(F.desc("weight"), "c_nationkey", "c_custkey")


@query(
    "cap_with_held",
    """SELECT o_custkey, count(*) AS n, least(count(*), 8) AS shown, greatest(count(*) - 8, 0) AS held FROM orders GROUP BY 1""",
)
def cap_with_held(spark, sf_dir):
    """At most eight rows a group, the others counted."""
    rows, held = K.capped(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", 8, F.asc("o_orderkey"))
    shown = rows.groupBy("o_custkey").agg(F.count("*").alias("shown"))
    return shown.join(held, "o_custkey").select("o_custkey", (F.col("shown") + F.col("held")).alias("n"), "shown", "held")


@query(
    "strided_sample",
    """WITH n AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
       SELECT o_orderpriority, o_orderkey FROM n WHERE i IN (SELECT CAST(floor(k * n / 40.0) AS BIGINT) FROM range(40) t(k))""",
)
def strided_sample(spark, sf_dir):
    """A systematic sample of forty from each stratum."""
    return K.strided_by(read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", 40, "o_orderkey")


@query(
    "stratified_quotas",
    """WITH c AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1), e AS (SELECT *, n * 97.0::DOUBLE / sum(n) OVER () AS exact FROM c),
       l AS (SELECT *, greatest(CAST(floor(exact) AS BIGINT), 1) AS low FROM e)
       SELECT c_mktsegment, n, low + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, c_mktsegment) <= 97 - sum(low) OVER () THEN 1 ELSE 0 END AS quota FROM l""",
)
def stratified_quotas(spark, sf_dir):
    """Proportional quotas by largest remainder."""
    return K.quotas(read(spark, sf_dir, "customer"), "c_mktsegment", 97)


@query(
    "disjoint_samples",
    """SELECT o_orderpriority, count(*) FILTER (WHERE r % 2 = 0) AS first_half, count(*) FILTER (WHERE r % 2 = 1) AS second_half, CAST(sum(CASE WHEN r % 2 = 1 THEN o_orderkey ELSE 0 END) AS BIGINT) AS id_sum
       FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders) GROUP BY 1""",
)
def disjoint_samples(spark, sf_dir):
    """Even and odd rows of each stratum, two samples that share no row."""
    odd = F.col("rank") % 2 == 0  # ranks count from 0
    rows = K.ranked(read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey")
    return rows.groupBy("o_orderpriority").agg(F.count_if(~odd).alias("first_half"), F.count_if(odd).alias("second_half"), F.sum(F.when(odd, F.col("o_orderkey")).otherwise(0)).alias("id_sum"))


@query("frequency_guard", "SELECT l_orderkey, l_partkey FROM (SELECT l_orderkey, l_partkey, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem) WHERE n BETWEEN 2 AND 25")
def frequency_guard(spark, sf_dir):
    """Keys that are neither unique nor on too many records."""
    return K.frequency_guard(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), "l_partkey", 2, 25)


@query(
    "disambiguate_names",
    """WITH g AS (SELECT p_partkey, p_name, p_brand, count(*) OVER (PARTITION BY p_name) AS n, count(*) OVER (PARTITION BY p_name, p_brand) AS nb FROM part)
       SELECT p_partkey, CASE WHEN n > 1 THEN CASE WHEN nb = 1 THEN p_name || ' (' || p_brand || ')' ELSE p_name || ' (' || p_partkey || ')' END ELSE p_name END AS label FROM g""",
)
def disambiguate_names(spark, sf_dir):
    """Repeated names take the first suffix that tells them apart."""
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return K.disambiguate(rows, "p_name", "p_brand", "p_partkey").select("p_partkey", "label")


@query(
    "round_robin_spread",
    """WITH r AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r, p_retailprice FROM part)
       SELECT p_partkey, p_type FROM r ORDER BY r > 2, p_retailprice DESC, p_partkey LIMIT 24""",
)
def round_robin_spread(spark, sf_dir):
    """The first two of each kind, then the rest, twenty-four at most."""
    rows, _ = K.capped(read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice"), "p_type", 24, F.desc("p_retailprice"), F.asc("p_partkey"))
    return rows.orderBy(F.col("rank") > 2, F.desc("p_retailprice"), "p_partkey").limit(24).select("p_partkey", "p_type")


@query(
    "earliest_causing_record",
    """SELECT l_orderkey, arg_min(l_linenumber, struct_pack(a := l_shipdate, b := l_linenumber, c := l_partkey)) AS l_linenumber, CAST(min(l_shipdate) AS DATE)::VARCHAR AS day FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""",
)
def earliest_causing_record(spark, sf_dir):
    """The first record that carries the new stage."""
    rows = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey")
    return rows.agg(F.min_by("l_linenumber", F.struct("l_shipdate", "l_linenumber", "l_partkey")).alias("l_linenumber"), F.min("l_shipdate").cast("date").cast("string").alias("day"))
