"""Register queries: filters, pages, facets."""

from datetime import datetime

from pyspark.sql import functions as F

from sparrowgrid.functions import predicates as P
from sparrowgrid.operators import register as R
from sparrowgrid.plans.registry import query
from sparrowgrid.session import read


@query(
    "register_page",
    """SELECT o_orderkey, o_orderstatus, o_totalprice, c_name, c_mktsegment
       FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'
       ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC LIMIT 50 OFFSET 50""",
)
def register_page(spark, sf_dir):
    """The second page: filtered, sorted with nulls last and an id tie-break, then 50 rows joined to their party."""
    orders = read(spark, sf_dir, "orders").where(P.RecordQuery(without={"o_orderstatus": ["P"]}).compile())
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    page = R.page(orders, "o_totalprice", "o_orderkey", number=2)
    joined = page.join(customers, "o_custkey").select("o_orderkey", "o_orderstatus", "o_totalprice", "c_name", "c_mktsegment")
    return joined.orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey")  # a join keeps no order


@query(
    "page_nulls_last",
    """SELECT o_orderkey, CASE WHEN o_totalprice < 200000 THEN NULL ELSE o_totalprice END AS significance FROM orders
       ORDER BY significance ASC NULLS LAST, o_orderkey LIMIT 100""",
)
def page_nulls_last(spark, sf_dir):
    """An ascending page with nulls last."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice") >= 200000, F.col("o_totalprice")).alias("significance"))
    return R.page(rows, "significance", "o_orderkey", descending=False, size=100)


@query("search_or_ilike", "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_name ILIKE '%red%' OR p_brand ILIKE '%red%' OR p_type ILIKE '%red%'")
def search_or_ilike(spark, sf_dir):
    """Free text over three fields."""
    return read(spark, sf_dir, "part").where(P.search(["p_name", "p_brand", "p_type"], ' "RED" ')).select("p_partkey", "p_name", "p_brand", "p_type")


@query("loose_equality", "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'")
def loose_equality(spark, sf_dir):
    """Equality in any case, spacing collapsed."""
    return read(spark, sf_dir, "customer").where(P.loosely_equal("c_mktsegment", "  buiLding ")).select("c_custkey", "c_mktsegment")


@query("null_or_in_scope", "SELECT c_custkey, nullif(c_mktsegment, 'MACHINERY') AS country FROM customer WHERE nullif(c_mktsegment, 'MACHINERY') IS NULL OR nullif(c_mktsegment, 'MACHINERY') IN ('BUILDING')")
def null_or_in_scope(spark, sf_dir):
    """Unresolved rows are in scope."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("country"))
    return rows.where(P.null_or_in("country", ["BUILDING"]))


@query("not_in_excludes_null", "SELECT nullif(o_orderstatus, 'P') AS status, count(*) AS n FROM orders WHERE nullif(o_orderstatus, 'P') NOT IN ('F') GROUP BY 1")
def not_in_excludes_null(spark, sf_dir):
    """NOT IN drops null."""
    rows = read(spark, sf_dir, "orders").select(F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"))
    return rows.where(P.not_in("status", ["F"])).groupBy("status").agg(F.count("*").alias("n"))


@query("distinct_from_keeps_null", "SELECT nullif(o_orderstatus, 'P') AS status, count(*) AS n FROM orders WHERE nullif(o_orderstatus, 'P') IS DISTINCT FROM 'F' GROUP BY 1")
def distinct_from_keeps_null(spark, sf_dir):
    """IS DISTINCT FROM keeps null."""
    rows = read(spark, sf_dir, "orders").select(F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"))
    return rows.where(P.differs("status", "F")).groupBy("status").agg(F.count("*").alias("n"))


@query("folded_post_filter", "SELECT p_type, count(*) AS n FROM part WHERE lower(p_type) IN ('economy', 'promo') GROUP BY p_type")
def folded_post_filter(spark, sf_dir):
    """Membership after folding case and spaces."""
    return read(spark, sf_dir, "part").where(P.folded_in("p_type", [" Economy", "PROMO "])).groupBy("p_type").agg(F.count("*").alias("n"))


@query(
    "stream_date_column",
    """SELECT l_returnflag, count(*) AS n, CAST(max(CASE WHEN l_returnflag = 'R' THEN l_shipdate + INTERVAL 30 DAY ELSE l_shipdate END) AS DATE)::VARCHAR AS newest
       FROM lineitem WHERE (CASE WHEN l_returnflag = 'R' THEN l_shipdate + INTERVAL 30 DAY ELSE l_shipdate END) >= TIMESTAMP '1998-01-01' GROUP BY 1""",
)
def stream_date_column(spark, sf_dir):
    """The date a stream is sorted and filtered by: the deadline of one, the published day of the others."""
    day = F.when(F.col("l_returnflag") == "R", F.col("l_shipdate") + F.expr("interval 30 days")).otherwise(F.col("l_shipdate"))
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", day.alias("day")).where(F.col("day") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.max("day").cast("date").cast("string").alias("newest"))


@query(
    "recency_keeps_undated",
    """SELECT (d IS NULL) AS undated, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS d FROM orders)
       WHERE d IS NULL OR d >= TIMESTAMP '2000-01-01' GROUP BY 1""",
)
def recency_keeps_undated(spark, sf_dir):
    """The recency gate keeps rows without a date."""
    rows = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("d"))
    return rows.where(P.recent_or_undated("d", datetime(2000, 1, 1))).groupBy(F.col("d").isNull().alias("undated")).agg(F.count("*").alias("n"))


@query("facet_counts", "SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 100000 GROUP BY 1 ORDER BY n DESC, value")
def facet_counts(spark, sf_dir):
    """Counts of a field's values under the page's filter, most first."""
    q = P.RecordQuery(among={"o_orderstatus": ["F", "O"]}, least={"o_totalprice": 100000.0})
    return R.facet(read(spark, sf_dir, "orders"), "o_orderpriority", q).orderBy(F.desc("n"), "value")


@query("facet_self_excluding", "SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def facet_self_excluding(spark, sf_dir):
    """A facet ignores the filter on its own axis."""
    q = P.RecordQuery(equal={"o_orderstatus": "F"}, among={"o_orderpriority": ["5-LOW"]})
    return R.facet(read(spark, sf_dir, "orders"), "o_orderpriority", q)


@query(
    "facet_child_distinct",
    """SELECT l_returnflag AS value, count(DISTINCT l_orderkey) AS n FROM lineitem
       WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1""",
)
def facet_child_distinct(spark, sf_dir):
    """Distinct projects by a value of their records."""
    orders = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.child_facet(orders, read(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query(
    "facet_values_with_zeros",
    """SELECT v.value, count(o_orderkey) AS n FROM (VALUES ('1-URGENT'), ('5-LOW'), ('9-NEVER')) v(value)
       LEFT JOIN orders ON o_orderpriority = v.value GROUP BY 1""",
)
def facet_values_with_zeros(spark, sf_dir):
    """Counts of listed values, zeros kept."""
    return R.listed_counts(read(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "5-LOW", "9-NEVER"])


@query("null_bucket", "SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS unresolved, count(*) AS total FROM orders")
def null_bucket(spark, sf_dir):
    """How many rows have no value."""
    status = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return read(spark, sf_dir, "orders").agg(F.count_if(status.isNull()).alias("unresolved"), F.count("*").alias("total"))


@query("exact_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('P') AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def exact_count(spark, sf_dir):
    """A page's exact count, with a half-open range."""
    q = P.RecordQuery(without={"o_orderstatus": ["P"]}, least={"o_orderdate": datetime(1996, 1, 1)}, before={"o_orderdate": datetime(1997, 1, 1)})
    return read(spark, sf_dir, "orders").where(q.compile()).agg(F.count("*").alias("n"))


@query(
    "top_k_search",
    """SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_name ILIKE '%blue%' ORDER BY p_retailprice DESC, p_partkey LIMIT 12""",
)
def top_k_search(spark, sf_dir):
    """The palette's search: twelve at most."""
    rows = read(spark, sf_dir, "part").where(P.search(["p_name"], "blue")).select("p_partkey", "p_name", "p_retailprice")
    return rows.orderBy(F.desc("p_retailprice"), "p_partkey").limit(12)


@query(
    "enum_order_sort",
    """SELECT o_orderpriority, count(*) AS n, coalesce(list_position(['5-LOW', '1-URGENT', '3-MEDIUM'], o_orderpriority), 99) AS place
       FROM orders GROUP BY 1 ORDER BY place, o_orderpriority""",
)
def enum_order_sort(spark, sf_dir):
    """Sorting by a listed order, unknown values last."""
    rows = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*map(F.lit, ("5-LOW", "1-URGENT", "3-MEDIUM"))), F.col("o_orderpriority"))
    return rows.withColumn("place", F.when(place > 0, place).otherwise(99).cast("int")).orderBy("place", "o_orderpriority")


@query(
    "set_union_intersect_except",
    """SELECT 'both' AS part, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')
       UNION ALL SELECT 'only_first', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')
       UNION ALL SELECT 'either', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')""",
)
def set_union_intersect_except(spark, sf_dir):
    """Set operations on ids, by one aggregate over both sides' flags."""
    rows = read(spark, sf_dir, "lineitem").where("l_returnflag in ('R', 'A')").groupBy("l_partkey").agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_returnflag") == "A").alias("a")
    )
    one = rows.agg(F.count_if(F.col("r") & F.col("a")).alias("both"), F.count_if(F.col("r") & ~F.col("a")).alias("only_first"), F.count("*").alias("either"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("n")) for p in ("both", "only_first", "either")])))
