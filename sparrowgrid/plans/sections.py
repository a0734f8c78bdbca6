"""Queries on sections of documents made of the tables' own words."""

from pyspark.sql import functions as F

from sparrowgrid.plans.registry import query
from sparrowgrid.session import read_spread
from sparrowgrid.sources import sections as S


def packets(spark, sf_dir):
    """Every order's lines as a packet of two pages: numbered headings and items with wrapped titles, and a body behind the outline."""
    line = F.col("l_linenumber")
    top = F.concat(line, F.lit("."), F.when(line % 2 == 1, " General  Business").otherwise(F.concat(F.lit(" Part "), "l_partkey", F.lit(" and more"))))
    sub = F.concat(F.lit("  "), line, F.lit(".1 Change order "), "l_suppkey", F.lit("\n   of "), "l_shipdate", F.when(F.col("l_quantity") > 25, "\n\n and its annex").otherwise(""))
    rows = read_spread(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("date").cast("string"))
    per = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", F.concat_ws("\n", top, sub).alias("said")))).alias("x"))
    first = F.concat(F.lit("Agenda\n"), F.array_join(F.col("x.said"), "\n"))
    return per.select("l_orderkey", F.array(first, F.lit("8. Closing\nAdjourn"), F.lit("9. A staff report behind the outline")).alias("pages"))


@query(
    "packet_outlines",
    """WITH l AS (SELECT l_orderkey, l_linenumber AS n, l_partkey, l_suppkey, l_shipdate::DATE::VARCHAR AS d, l_quantity > 25 AS annex FROM lineitem)
       SELECT l_orderkey, n::VARCHAR AS num, 'Part ' || l_partkey || ' and more' AS title FROM l WHERE n % 2 = 0
       UNION ALL SELECT l_orderkey, n || '.1', 'Change order ' || l_suppkey || ' of ' || d || CASE WHEN annex THEN ' and its annex' ELSE '' END FROM l
       UNION ALL SELECT DISTINCT l_orderkey, '8', 'Closing Adjourn' FROM l""",
)
def packet_outlines(spark, sf_dir):
    """The items of every packet's outline."""
    return S.outline(packets(spark, sf_dir), "l_orderkey", "pages").select("l_orderkey", "num", "title")


@query(
    "heading_paths",
    """WITH h AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place, l_suppkey % 4 AS level, l_partkey::VARCHAR AS title FROM lineitem),
         p AS (SELECT a.l_orderkey, a.place, b.level, b.title, b.place AS spot FROM h a JOIN h b ON b.l_orderkey = a.l_orderkey AND b.place <= a.place
           WHERE b.place = a.place OR b.level < (SELECT min(c.level) FROM h c WHERE c.l_orderkey = a.l_orderkey AND c.place > b.place AND c.place <= a.place))
       SELECT l_orderkey, place, string_agg(title, ' > ' ORDER BY spot) AS path FROM p GROUP BY 1, 2""",
)
def heading_paths(spark, sf_dir):
    """Every heading's path, levels being left out here and there."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = read_spread(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(order).alias("place"), (F.col("l_suppkey") % 4).alias("level"), F.col("l_partkey").cast("string").alias("title"))
    return S.heading_tree(rows, "l_orderkey", "place", "level", "title").select("l_orderkey", "place", F.array_join("path", " > ").alias("path"))


@query(
    "plan_provisions",
    """WITH l AS (SELECT l_orderkey, l_linenumber AS n, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS page, l_suppkey % 6 AS k, l_partkey % 3 AS z FROM lineitem),
         h AS (SELECT l_orderkey, page, CASE k WHEN 0 THEN 'theme park' WHEN 1 THEN 'entertainment, tourist' WHEN 2 THEN 'recreation, theme park' WHEN 3 THEN 'entertainment, recreation' END AS hits FROM l WHERE k < 4 AND z > 0),
         o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, hits ORDER BY page) AS nth FROM h)
       SELECT l_orderkey, page, hits, CASE WHEN contains(hits, 'theme park') THEN 'theme park' ELSE replace(hits, ', ', ' / ') END || ' provisions' AS focus FROM o WHERE nth = 1 OR contains(hits, 'theme park')""",
)
def plan_provisions(spark, sf_dir):
    """Provisions for leisure in every plan, page by page."""
    k, z = F.col("l_suppkey") % 6, F.col("l_partkey") % 3
    said = F.when(k == 0, "A Theme Park of ").when(k == 1, "Entertainment for the tourist and ").when(k == 2, "recreation near the theme  park, a theme park ").when(k == 3, "recreation, entertainment ").when(k == 4, "tourist ").otherwise("nothing ")
    text = F.concat(said, F.when(z == 0, "without context").when(z == 1, "in the Zoning of").otherwise("with some acres"))
    rows = read_spread(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", text.alias("said")))).alias("x"))
    return S.plan_sections(rows.select("l_orderkey", F.col("x.said").alias("pages")), "l_orderkey", "pages")
