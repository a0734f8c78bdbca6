"""Queries on names, edits and blocks of project entries."""

from pyspark.sql import functions as F

from sparrowgrid.functions import facts as X
from sparrowgrid.operators import naming as N
from sparrowgrid.operators import scopes as S
from sparrowgrid.operators import writes as W
from sparrowgrid.plans.registry import query
from sparrowgrid.session import read
from sparrowgrid.sources import readers


@query(
    "clean_titles",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Rezoning for ' || p_name WHEN 1 THEN 'Downtown Arena Project' WHEN 2 THEN 'A tower of ' || p_name ELSE NULL END AS title FROM part""",
)
def clean_titles(spark, sf_dir):
    """Subjects of agenda titles."""
    k = F.col("p_partkey") % 4
    said = (
        F.when(k == 0, F.concat(F.lit("12. Public hearing: Rezoning for "), "p_name", F.lit("  Location: 5 Elm St APN: 1")))
        .when(k == 1, "ITEM 7) ORDINANCE NO. 12-A - DOWNTOWN ARENA PROJECT.")
        .when(k == 2, F.concat(F.lit("“A tower of "), "p_name", F.lit("”, ")))
        .otherwise("3. ")
    )
    return read(spark, sf_dir, "part").select("p_partkey", N.clean_title(said).alias("title"))


@query(
    "project_name_ladder",
    """WITH r AS (SELECT l_orderkey AS p, l_linenumber AS o, CASE WHEN l_orderkey % 5 = 0 AND l_linenumber = 1 THEN 'Heart Hotel' END AS target, CASE WHEN l_orderkey % 5 = 1 THEN 'Programme ' || (l_suppkey % 3) END AS programme,
           CASE WHEN l_orderkey % 5 = 2 THEN 'Firm ' || (l_suppkey % 2) END AS applicant, CASE WHEN l_orderkey % 5 = 3 THEN 'A long enough title ' || l_linenumber || ' ' || l_suppkey END AS title FROM lineitem),
         n AS (SELECT p, programme AS v, count(*) AS n, min(o) AS f FROM r WHERE programme IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT p, applicant || ' Hotel', count(*), min(o) FROM r WHERE applicant IS NOT NULL GROUP BY 1, 2),
         m AS (SELECT p, arg_min(v, struct_pack(a := -n, b := f, c := v)) AS v FROM n GROUP BY 1), t AS (SELECT p, arg_min(title, struct_pack(a := o, b := title)) AS v FROM r WHERE title IS NOT NULL GROUP BY 1)
       SELECT DISTINCT r.p AS project, CASE r.p % 5 WHEN 0 THEN coalesce((SELECT min(target) FROM r q WHERE q.p = r.p), 'Project ' || r.p) WHEN 3 THEN t.v WHEN 4 THEN 'Project ' || r.p ELSE m.v END AS name,
         CASE r.p % 5 WHEN 0 THEN CASE WHEN (SELECT min(target) FROM r q WHERE q.p = r.p) IS NULL THEN 'fallback' ELSE 'target' END WHEN 1 THEN 'programme' WHEN 2 THEN 'applicant' WHEN 3 THEN 'title' ELSE 'fallback' END AS rung
       FROM r LEFT JOIN m ON m.p = r.p LEFT JOIN t ON t.p = r.p""",
)
def project_name_ladder(spark, sf_dir):
    """What every project is called, and after what."""
    k = F.col("l_orderkey") % 5
    none = F.lit(None).cast("string")
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("project"), F.col("l_linenumber").alias("at"), F.when((k == 0) & (F.col("l_linenumber") == 1), "Heart Hotel").alias("target"), none.alias("source"),
        F.when(k == 1, F.concat(F.lit("Programme "), (F.col("l_suppkey") % 3).cast("string"))).alias("programme"), F.when(k == 2, F.concat(F.lit("Firm "), (F.col("l_suppkey") % 2).cast("string"))).alias("applicant"),
        F.when(k == 2, "Hotel").alias("venue"), none.alias("address"),
        F.when(k == 3, F.concat_ws(" ", F.lit("4. A long enough title"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"))).when(k == 4, "short").alias("title"),
    )
    return N.project_names(rows, "project", "at")


@query(
    "edit_provenance",
    """SELECT o_orderkey, 'o_orderpriority' AS field, o_orderpriority AS previous, '1-URGENT' AS next, '2024-01-01' AS at FROM orders WHERE o_orderkey % 5 = 0 AND o_orderpriority <> '1-URGENT'""",
)
def edit_provenance(spark, sf_dir):
    """What each manual edit replaced, with what and when."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    edits = rows.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("1-URGENT").alias("value"), F.lit("2024-01-01").alias("at"))
    return W.edit_log(rows, edits, "o_orderkey", "o_orderpriority")


@query(
    "clients_repointed",
    """WITH m AS (SELECT c_custkey AS loser, min(c_custkey) OVER (PARTITION BY c_mktsegment, c_nationkey) AS winner FROM customer)
       SELECT DISTINCT winner AS client, o_orderpriority AS scope FROM orders JOIN m ON loser = o_custkey""",
)
def clients_repointed(spark, sf_dir):
    """The children of merged clients under the survivor, once each."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    first = c.groupBy("c_mktsegment", "c_nationkey").agg(F.min("c_custkey").alias("winner"))
    merges = c.join(first, ["c_mktsegment", "c_nationkey"]).where("c_custkey <> winner").select(F.col("c_custkey").alias("loser"), "winner")
    edges = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("client"), F.col("o_orderpriority").alias("scope"))
    return S.repoint(edges, merges, "client", ["scope"])


@query(
    "stated_blocks",
    """WITH f AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber, l_suppkey) AS k FROM lineitem)
       SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY k) FILTER (WHERE k <= 3) AS shown, greatest(0, count(*) - 3) AS held FROM f GROUP BY 1""",
)
def stated_blocks(spark, sf_dir):
    """A project's three largest figures and how many are held back."""
    from sparrowgrid.operators.ranking import top_block

    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_partkey", "l_linenumber", "l_suppkey")
    out = top_block(rows, "l_orderkey", 3, F.desc("l_extendedprice"), "l_partkey", "l_linenumber", "l_suppkey", value="l_partkey")
    return out.select("l_orderkey", F.array_join("shown", ",").alias("shown"), "held")


@query(
    "agenda_items",
    """SELECT r_regionkey, k AS number, CASE k WHEN 1 THEN 'Call to order' WHEN 2 THEN 'Rezoning in ' || r_name ELSE 'Adjourn' END AS item FROM region, (VALUES (1), (2), (3)) v(k)""",
)
def agenda_items(spark, sf_dir):
    """The numbered items of agendas."""
    said = F.concat(F.lit("AGENDA\n1. Call to order\n2) Rezoning in "), "r_name", F.lit("\n 3. Adjourn\n"))
    return readers.numbered_items(read(spark, sf_dir, "region").select("r_regionkey", said.alias("text"))).select("r_regionkey", "number", "item")


@query(
    "conditional_json",
    """SELECT event_type, count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50) AS high, count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NULL) AS without FROM events GROUP BY 1""",
)
def conditional_json(spark, sf_dir):
    """Conditional counts by a JSON key."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(k >= 50).alias("high"), F.count_if(k.isNull()).alias("without"))


@query(
    "fact_kinds",
    """SELECT 'rooms' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'acres', count(*) FROM orders""",
)
def fact_kinds(spark, sf_dir):
    """Facts by kind over all texts, as the census of an extractor counts them."""
    said = F.concat(F.lit("A "), (F.col("o_custkey") % 50 + 3).cast("string"), F.lit("-room inn on "), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit(" acres, ground floor, room 5."))
    rows = X.fact_rows(read(spark, sf_dir, "orders").select("o_orderkey", said.alias("said")), "o_orderkey", "said")
    return rows.groupBy("kind").agg(F.count("*").alias("n"))
