"""Queries on parties, names and records of entities."""

from pyspark.sql import functions as F

from sparrowgrid.functions import text as X
from sparrowgrid.operators import ranking as K
from sparrowgrid.operators import resolve as E
from sparrowgrid.plans.registry import query
from sparrowgrid.session import read, read_spread


@query(
    "entity_in_text",
    """WITH e AS (SELECT DISTINCT p_type, split_part(p_name, ' ', 2) AS name FROM part), h AS (
         SELECT p_partkey, e.name FROM part p JOIN e ON e.p_type = p.p_type AND contains(lower(p.p_name), lower(e.name)))
       SELECT p_partkey, min(name) AS entity FROM h GROUP BY 1 HAVING count(DISTINCT name) = 1""",
)
def entity_in_text(spark, sf_dir):
    """Records whose text holds exactly one known entity of their market."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    known = part.select("p_type", F.split("p_name", " ")[1].alias("name")).distinct()
    return E.single_entity_hits(part, known, "p_partkey", "p_name", "p_type", "name")


@query(
    "contained_figures",
    """WITH v AS (SELECT DISTINCT p_type, substr(p_name || ' ' || p_brand, 1, 9 + CAST(p_partkey % 8 AS INT)) AS v FROM part)
       SELECT p_type, v FROM v a WHERE length(v) < 6 OR NOT EXISTS (SELECT 1 FROM v b WHERE b.p_type = a.p_type AND length(b.v) > length(a.v) AND contains(b.v, a.v))""",
)
def contained_figures(spark, sf_dir):
    """Figures that are no part of a longer one of the same source."""
    rows = read(spark, sf_dir, "part").select("p_type", F.expr("substring(concat_ws(' ', p_name, p_brand), 1, 9 + cast(p_partkey % 8 as int))").alias("v")).distinct()
    return E.without_contained(rows, "p_type", "v")


@query(
    "prefix_parties",
    """WITH k AS (SELECT DISTINCT p_size, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE split_part(p_name, ' ', 1) END AS k FROM part)
       SELECT a.p_size, a.k AS name, coalesce(arg_max(b.k, struct_pack(n := length(b.k), k := b.k)), a.k) AS merged FROM k a LEFT JOIN k b ON b.p_size = a.p_size AND starts_with(b.k, a.k || ' ') GROUP BY 1, 2""",
)
def prefix_parties(spark, sf_dir):
    """Short party names merged into the longer ones they begin."""
    keys = read(spark, sf_dir, "part").select("p_size", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.split("p_name", " ")[0]).alias("name"))
    return E.merge_prefixes(keys, "p_size", "name")


@query(
    "richest_duplicate",
    """WITH r AS (SELECT p_name, p_partkey, nullif(p_brand, 'Brand#3') AS brand, nullif(p_type, 'PROMO') AS type FROM part)
       SELECT p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY (brand IS NOT NULL)::INT + (type IS NOT NULL)::INT DESC, p_partkey) AS k FROM r) WHERE k = 1""",
)
def richest_duplicate(spark, sf_dir):
    """Of duplicates the one with most fields filled."""
    rows = read(spark, sf_dir, "part").select("p_name", "p_partkey", F.nullif(F.col("p_brand"), F.lit("Brand#3")).alias("brand"), F.nullif(F.col("p_type"), F.lit("PROMO")).alias("type"))
    return E.richest(rows, "p_name", "p_partkey", "brand", "type").select("p_name", "p_partkey")


@query(
    "duplicate_clients",
    """WITH c AS (SELECT o_custkey, o_orderpriority, min(o_orderdate) AS created, min(o_orderkey) AS id FROM orders GROUP BY 1, 2)
       SELECT o_custkey, arg_min(id, struct_pack(d := created, i := id)) AS survivor, count(*) - 1 AS merged FROM c GROUP BY 1""",
)
def duplicate_clients(spark, sf_dir):
    """The earliest of each client's entries survives; the others merge into it."""
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderdate").alias("created"), F.min("o_orderkey").alias("id"))
    return rows.groupBy("o_custkey").agg(F.min_by("id", F.struct("created", "id")).alias("survivor"), (F.count("*") - 1).alias("merged"))


@query("near_duplicate_merge")
def near_duplicate_merge(spark, sf_dir):
    """Records of one project and day that say the same, merged."""
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.split(F.concat_ws(" ", "p_name", "p_brand", "p_type"), " ").alias("words"))
    return E.near_duplicate_records(rows, "p_partkey", ["p_size"], "words", least=0.6, shared=2)


@query(
    "naming_ladder",
    """SELECT p_partkey, CASE WHEN p_size > 45 THEN p_brand WHEN p_type = 'PROMO' THEN p_name ELSE 'Part ' || p_partkey END AS name,
       CASE WHEN p_size > 45 THEN 'target' WHEN p_type = 'PROMO' THEN 'source' ELSE 'fallback' END AS rung FROM part""",
)
def naming_ladder(spark, sf_dir):
    """A project's name from the first rung that has one."""
    named = E.project_name(
        {"target": F.when(F.col("p_size") > 45, F.col("p_brand")), "source": F.when(F.col("p_type") == "PROMO", F.col("p_name")), "fallback": F.concat(F.lit("Part "), F.col("p_partkey"))}
    )
    return read(spark, sf_dir, "part").select("p_partkey", named.alias("n")).select("p_partkey", "n.name", "n.rung")


@query(
    "party_extraction",
    """SELECT role, count(*) AS n, count(DISTINCT key) AS parties FROM (SELECT DISTINCT o_orderkey, 'applicant' AS role, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS key FROM orders JOIN customer ON o_custkey = c_custkey
       UNION ALL SELECT DISTINCT o_orderkey, 'representative', trim(regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', ' ', 'g')) FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1""",
)
def party_extraction(spark, sf_dir):
    """Parties by role, public bodies refused."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    rows = read_spread(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey").withColumn("clerk", F.lit("City of Nowhere"))
    found = E.parties(rows, "o_orderkey", {"c_name": "applicant", "c_mktsegment": "representative", "clerk": "presenter"}, X.entity_key)
    return found.groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("key").alias("parties"))


@query(
    "party_block",
    """WITH m AS (SELECT l_orderkey, lower(l_returnflag) || ' party ' || (l_suppkey % 3) AS key, count(DISTINCT l_linestatus) AS mentions FROM lineitem GROUP BY 1, 2)
       SELECT l_orderkey, key, mentions, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY mentions DESC, key) AS INT) AS place FROM m""",
)
def party_block(spark, sf_dir):
    """A project's parties with their mentions, in order."""
    name = F.concat(F.col("l_returnflag"), F.lit(" Party "), (F.col("l_suppkey") % 3).cast("string"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linestatus") == "F", name).alias("a"), F.when(F.col("l_linestatus") == "O", name).alias("b"))
    found = E.parties(rows, "l_orderkey", {"a": "applicant", "b": "owner"}, X.entity_key)
    return E.party_blocks(found, "l_orderkey").select("l_orderkey", "key", "mentions", "place")


@query(
    "distinguishing_key",
    """WITH g AS (SELECT p_partkey, p_type, p_brand, p_size, count(DISTINCT p_brand) OVER (PARTITION BY p_type, p_name) AS x, count(*) OVER (PARTITION BY p_type, p_name, p_brand) AS b, count(*) OVER (PARTITION BY p_type, p_name, p_size) AS s, p_name FROM part)
       SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_type, p_name) = 1 THEN p_name WHEN b = 1 THEN p_name || ' (' || p_brand || ')' WHEN s = 1 THEN p_name || ' (' || p_size || ')' ELSE p_name END AS label FROM g""",
)
def distinguishing_key(spark, sf_dir):
    """The first field that tells equal names of a kind apart."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws("\x1f", "p_type", "p_name").alias("name"), "p_brand", "p_size")
    labelled = K.disambiguate(rows, "name", "p_brand", "p_size")
    return labelled.select("p_partkey", F.element_at(F.split("label", "\x1f"), -1).alias("label"))


@query(
    "membership_tally",
    """SELECT c_mktsegment, count(*) FILTER (WHERE c_custkey % 3 = 0) AS proposed, count(*) FILTER (WHERE c_custkey % 3 = 1) AS included, count(*) FILTER (WHERE c_custkey % 3 = 2) AS excluded FROM customer GROUP BY 1""",
)
def membership_tally(spark, sf_dir):
    """Counts of each membership status, zeros kept."""
    rows = read(spark, sf_dir, "customer").select("c_mktsegment", F.element_at(F.array(*map(F.lit, ("proposed", "included", "excluded"))), (F.col("c_custkey") % 3 + 1).cast("int")).alias("status"))
    return rows.groupBy("c_mktsegment").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("proposed", "included", "excluded")])


@query(
    "players_summary",
    """WITH p AS (SELECT l_suppkey, count(DISTINCT l_returnflag) AS roles, count(DISTINCT l_linestatus) AS markets, count(*) AS n FROM lineitem GROUP BY 1)
       SELECT count(*) AS total, count(*) FILTER (WHERE n IS NOT NULL) AS attached, count(*) FILTER (WHERE roles > 1) AS multi_role, count(*) FILTER (WHERE markets > 1) AS multi_market FROM supplier LEFT JOIN p ON l_suppkey = s_suppkey""",
)
def players_summary(spark, sf_dir):
    """How many companies are attached, in several roles, in several markets, by all records."""
    per = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.countDistinct("l_returnflag").alias("roles"), F.countDistinct("l_linestatus").alias("markets"))
    rows = read(spark, sf_dir, "supplier").select("s_suppkey").join(per, "s_suppkey", "left")
    return rows.agg(F.count("*").alias("total"), F.count("roles").alias("attached"), F.count_if(F.col("roles") > 1).alias("multi_role"), F.count_if(F.col("markets") > 1).alias("multi_market"))


@query(
    "summary_from_newest",
    """WITH r AS (SELECT l_orderkey, l_shipdate, l_linenumber, l_partkey, 'requests approval of part ' || l_partkey || ' at quantity ' || CAST(l_quantity AS INT) AS said FROM lineitem WHERE l_returnflag <> 'N')
       SELECT l_orderkey, arg_max(said, struct_pack(a := l_shipdate, b := l_linenumber, c := l_partkey)) AS summary FROM r GROUP BY 1""",
)
def summary_from_newest(spark, sf_dir):
    """A project's summary: the newest record that says enough about an action."""
    said = F.concat(F.lit("requests approval of part "), F.col("l_partkey"), F.lit(" at quantity "), F.col("l_quantity").cast("int"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") != "N", said).alias("said"))
    good = rows.where((F.length("said") >= 25) & F.col("said").rlike("approval|request"))
    return good.groupBy("l_orderkey").agg(F.max_by("said", F.struct("l_shipdate", "l_linenumber", "l_partkey")).alias("summary"))


@query("bulk_status", "SELECT o_orderstatus, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'dismissed' ELSE 'kept' END AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def bulk_status(spark, sf_dir):
    """A status set on a set of ids."""
    ids = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.lit("dismissed").alias("status"))
    rows = read(spark, sf_dir, "orders").join(ids, "o_custkey", "left").select("o_orderstatus", F.coalesce("status", F.lit("kept")).alias("status"))
    return rows.groupBy("o_orderstatus", "status").agg(F.count("*").alias("n"))


@query(
    "high_water_marks",
    """SELECT c_mktsegment, greatest(CAST(max(o_orderdate) AS DATE) - 30, DATE '2000-08-01')::VARCHAR AS since FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1""",
)
def high_water_marks(spark, sf_dir):
    """Where each source is read on from: an overlap before its newest row, never before the floor."""
    from sparrowgrid.sources.readers import high_water

    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderdate").cast("date").alias("day")).groupBy("o_custkey").agg(F.max("day").alias("day"))
    marks = high_water(rows.join(c, "o_custkey").withColumn("day", F.col("day").cast("string")), "c_mktsegment", "day", "2001-08-01")
    return marks.select("c_mktsegment", F.col("since").cast("string").alias("since"))
