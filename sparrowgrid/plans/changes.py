"""Write and resolution queries: upserts, events, clusters, names, stages, scores."""

from datetime import date

from pyspark.sql import functions as F

from sparrowgrid.functions import text as X
from sparrowgrid.operators import register as R
from sparrowgrid.operators import resolve as E
from sparrowgrid.operators import writes as W
from sparrowgrid.plans.registry import query
from sparrowgrid.session import read

_OLD = """old AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'dismissed' ELSE 'kept' END AS status, o_orderpriority AS stage,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS place, o_orderkey % 6 = 0 AS pinned FROM orders WHERE o_orderkey % 2 = 0)"""
_NEW = """new AS (SELECT o_orderkey, 'new' AS status, 'filed' AS stage, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'X' END AS place FROM orders WHERE o_orderkey % 5 <> 1)"""


def _versions(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    old = o.where(k % 2 == 0).select(
        "o_orderkey",
        F.when(k % 10 == 0, "dismissed").otherwise("kept").alias("status"),
        F.col("o_orderpriority").alias("stage"),
        F.when(k % 4 != 0, F.col("o_orderstatus")).alias("place"),
        F.when(k % 6 == 0, F.array(F.lit("stage"))).alias("overrides"),
    )
    new = o.where(k % 5 != 1).select("o_orderkey", F.lit("new").alias("status"), F.lit("filed").alias("stage"), F.when(k % 3 != 0, "X").alias("place"))
    return old, new


@query(
    "guarded_upsert",
    f"""WITH {_OLD}, {_NEW}
       SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey,
         CASE WHEN n.o_orderkey IS NULL THEN 'keep' WHEN o.o_orderkey IS NULL THEN 'insert' WHEN o.status = 'dismissed' THEN 'tombstone' ELSE 'update' END AS action,
         CASE WHEN o.o_orderkey IS NULL THEN n.status ELSE o.status END AS status,
         CASE WHEN o.o_orderkey IS NULL THEN n.stage WHEN n.o_orderkey IS NULL OR o.status = 'dismissed' OR o.pinned THEN o.stage ELSE n.stage END AS stage,
         CASE WHEN o.o_orderkey IS NULL THEN n.place WHEN n.o_orderkey IS NULL OR o.status = 'dismissed' THEN o.place ELSE coalesce(n.place, o.place) END AS place
       FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey""",
)
def guarded_upsert(spark, sf_dir):
    """The next version: dismissed rows stay dead, people's columns and pinned fields stay, nulls don't erase."""
    old, new = _versions(spark, sf_dir)
    return W.guarded_upsert(old, new, "o_orderkey", owned=["status"], enrichment=["place"]).drop("overrides")


@query("insert_if_absent", f"WITH {_OLD}, {_NEW} SELECT o_orderkey, stage FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)")
def insert_if_absent(spark, sf_dir):
    """Proposals that aren't stored yet."""
    old, new = _versions(spark, sf_dir)
    return W.insert_absent(old, new, ["o_orderkey"]).select("o_orderkey", "stage")


@query(
    "manual_edits",
    f"""WITH {_OLD} SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN '5-LOW' ELSE stage END AS stage, o_orderkey % 8 = 0 AND stage <> '5-LOW' AS changed FROM old""",
)
def manual_edits(spark, sf_dir):
    """Edits by hand; the same value again is no edit."""
    old, _ = _versions(spark, sf_dir)
    edits = old.where(F.col("o_orderkey") % 8 == 0).select("o_orderkey", F.lit("5-LOW").alias("value"))
    return W.apply_edits(old, edits, "o_orderkey", "stage").select("o_orderkey", "stage", "changed")


@query(
    "event_identity_dedupe",
    """WITH n AS (SELECT user_id, event_type, CAST(ts AS DATE)::VARCHAR AS day FROM events), s AS (SELECT DISTINCT user_id, event_type, day FROM n WHERE day < '2024-01-10'), d AS (SELECT DISTINCT * FROM n)
       SELECT event_type, count(*) AS n FROM d WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = d.user_id AND s.event_type = d.event_type AND s.day = d.day) GROUP BY 1""",
)
def event_identity_dedupe(spark, sf_dir):
    """Events to append, by type: each identity once, none that is stored."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("date").cast("string").alias("day"))
    fresh, _ = W.append_events(rows.where("day < '2024-01-10'"), rows, ["user_id", "event_type", "day"])
    return fresh.groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "change_events",
    f"""WITH {_OLD}, {_NEW}, j AS (SELECT n.o_orderkey, o.o_orderkey IS NULL AS fresh, o.stage AS os, n.stage AS ns, o.place AS op, n.place AS np FROM new n LEFT JOIN old o ON o.o_orderkey = n.o_orderkey)
       SELECT o_orderkey, 'created' AS event_type, NULL::VARCHAR AS from_value, NULL::VARCHAR AS to_value FROM j WHERE fresh
       UNION ALL SELECT o_orderkey, 'stage_changed', os, ns FROM j WHERE NOT fresh AND os IS DISTINCT FROM ns
       UNION ALL SELECT o_orderkey, 'place_set', op, np FROM j WHERE NOT fresh AND op IS DISTINCT FROM np""",
)
def change_events(spark, sf_dir):
    """What changed between two versions, one event a field."""
    old, new = _versions(spark, sf_dir)
    return W.change_events(old, new, "o_orderkey", {"stage": "stage_changed", "place": "place_set"})


@query(
    "version_diff",
    f"""WITH {_OLD}, {_NEW} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'new' WHEN n.o_orderkey IS NULL THEN 'gone' ELSE 'changed' END AS change
       FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.stage IS DISTINCT FROM n.stage OR o.place IS DISTINCT FROM n.place""",
)
def version_diff(spark, sf_dir):
    """Rows that are new, gone or changed."""
    old, new = _versions(spark, sf_dir)
    return R.diff(old, new, "o_orderkey", ["stage", "place"]).select("o_orderkey", "change")


@query(
    "lifecycle_sweep",
    """SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'red') THEN 'dead' WHEN DATE '2000-01-01' + CAST(p_size AS INT) < DATE '2000-01-26' THEN 'expired' ELSE 'active' END AS lifecycle FROM part""",
)
def lifecycle_sweep(spark, sf_dir):
    """Rows that a notice ended, or whose deadline passed."""
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", F.date_add(F.lit("2000-01-01").cast("date"), F.col("p_size")).alias("deadline"))
    return W.lifecycle(rows, date(2000, 1, 26), "p_name", "deadline", "red").select("p_partkey", "lifecycle")


def _lines(spark, sf_dir):
    """Whole lines as keys, however frequent; a document has its own key too, so that none is left out."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x))
    keys = F.array_append(F.transform(F.array_distinct(F.filter(lines, lambda x: x != "")), lambda x: F.concat(F.lit("l"), F.md5(x.cast("binary")))), F.concat(F.lit("r"), F.col("r")))
    return read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "r").select("r", F.posexplode(keys).alias("place", "k"))


@query("cluster_components")
def cluster_components(spark, sf_dir):
    """Records joined by any common line, however many hold it."""
    return E.connected(_lines(spark, sf_dir), "r", "k").select(F.col("r").alias("doc_id"), "component")


@query("cluster_guarded")
def cluster_guarded(spark, sf_dir):
    """Clusters by whole lines in which no two records carry different targets."""
    signals = _lines(spark, sf_dir).withColumn("target", F.when(F.col("r") % 50 == 0, (F.col("r") % 3).cast("string")))
    return E.guarded_components(signals, "r", "k", "target", "place").select(F.col("r").alias("doc_id"), "component")


@query("consolidate_names")
def consolidate_names(spark, sf_dir):
    """Company names and the canonical name each belongs to."""
    names = read(spark, sf_dir, "part").select(X.entity_key(F.concat_ws(" ", "p_name", "p_brand")).alias("name"))
    return E.consolidate(names)


@query(
    "stage_evidence",
    """WITH r AS (SELECT l_orderkey, l_linenumber % 6 AS rank, l_returnflag <> 'N' AS filing, l_quantity > 40 AND l_returnflag <> 'N' AS attributed FROM lineitem),
         n AS (SELECT l_orderkey, rank, count(*) AS n, count(*) FILTER (WHERE filing) AS filings, max(CASE WHEN filing THEN rank ELSE 0 END) AS capped, bool_or(attributed) AS attributed FROM r GROUP BY 1, 2),
         a AS (SELECT l_orderkey, sum(n) AS n, max(rank) AS top, max(capped) AS single, max(CASE WHEN capped <= 2 OR attributed OR filings >= 2 THEN capped END) AS proven FROM n GROUP BY 1),
         d AS (SELECT l_orderkey, top, CASE WHEN n <= 1 THEN single ELSE coalesce(proven, 0) END AS decided FROM a)
       SELECT l_orderkey, (['filed', 'hearing scheduled', 'approved', 'permitted', 'under construction', 'operating'])[CAST(decided AS INT) + 1] AS stage,
         CASE WHEN decided < top THEN (['filed', 'hearing scheduled', 'approved', 'permitted', 'under construction', 'operating'])[CAST(top AS INT) + 1] END AS refused FROM d""",
)
def stage_evidence(spark, sf_dir):
    """The stage that a project's records prove, and a higher one that they don't."""
    from sparrowgrid.functions.rules import STAGES

    stage = F.element_at(F.array(*map(F.lit, STAGES)), (F.col("l_linenumber") % 6 + 1).cast("int"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", stage.alias("stage"), (F.col("l_returnflag") != "N").alias("filing"), (F.col("l_quantity") > 40).alias("attributed"))
    return E.proven_stage(rows, "l_orderkey", "stage", "filing", "attributed").drop("press_reported")


@query(
    "project_liveness",
    """WITH a AS (SELECT l_orderkey, max(l_shipdate) AS last, min(l_shipdate) FILTER (WHERE l_shipdate > TIMESTAMP '2001-06-01') AS next FROM lineitem GROUP BY 1)
       SELECT l_orderkey, CASE WHEN next IS NOT NULL THEN 'future milestone' WHEN last IS NULL THEN 'undated' WHEN CAST(last AS DATE) >= DATE '2000-06-01' THEN 'recent activity' ELSE 'dormant' END AS reason FROM a""",
)
def project_liveness(spark, sf_dir):
    """Why a project is live, or dormant."""
    from sparrowgrid.functions.rules import liveness

    now = F.lit("2001-06-01").cast("date")
    day = F.col("l_shipdate").cast("date")
    per = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(day).alias("last"), F.min(F.when(day > now, day)).alias("next"))
    return per.select("l_orderkey", liveness(F.col("next"), F.col("last"), now).alias("reason"))


@query(
    "significance_score",
    """WITH a AS (SELECT l_orderkey, count(*) AS n, max(l_extendedprice) * 1000 AS money, bool_or(l_returnflag = 'R') AS target, date_diff('day', min(l_shipdate), max(l_shipdate)) AS span,
           date_diff('day', max(l_shipdate), TIMESTAMP '1998-12-01') AS idle, bool_and(l_linestatus = 'F') AS pen, max(CASE l_suppkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 6 ELSE 3 END) AS src FROM lineitem GROUP BY 1),
         b AS (SELECT a.*, o_custkey AS c, o_orderstatus AS s, o_orderpriority AS p FROM a JOIN orders ON o_orderkey = l_orderkey),
         p AS (SELECT l_orderkey, CASE WHEN money < 1e5 THEN 0 ELSE least(1, (log10(money) - 5) / 4) * 10 END AS m, CASE WHEN c % 3 <> 0 THEN 10 ELSE 0 END AS party, CASE WHEN c % 2 = 0 THEN 8 ELSE 0 END AS rep,
           CASE s WHEN 'F' THEN 14 WHEN 'O' THEN 6 ELSE 2 END AS stage, CASE WHEN n <= 1 THEN 0 ELSE least(1, log10(n) / log10(12)) * 12 END AS depth, CASE WHEN n >= 2 THEN least(1, span / 730.0::DOUBLE) * 3 ELSE 0 END AS spn,
           CASE p WHEN '1-URGENT' THEN 12 WHEN '2-HIGH' THEN 7.8 WHEN '3-MEDIUM' THEN 3.6 ELSE -6 END AS venue, CASE WHEN target THEN 15 ELSE 0 END AS target, src * 0.8::DOUBLE AS source,
           CASE WHEN idle <= 90 THEN 4 WHEN idle <= 365 THEN 2.8 WHEN idle <= 730 THEN 1.6 ELSE 0 END AS rec, CASE WHEN pen THEN -12 ELSE 0 END AS pen FROM b),
         r AS (SELECT l_orderkey, floor(m * 10 + 0.5) / 10 + party + rep + stage + floor(depth * 10 + 0.5) / 10 + floor(spn * 10 + 0.5) / 10 + venue::DOUBLE + target + floor(source * 10 + 0.5) / 10 + rec::DOUBLE + pen AS total FROM p)
       SELECT l_orderkey, floor(greatest(0, least(100, total)) * 10 + 0.5) / 10 AS score FROM r""",
)
def significance_score(spark, sf_dir):
    """Projects scored by all ten signals, less a penalty for pure transactions."""
    day, supp = F.col("l_shipdate").cast("date"), F.col("l_suppkey") % 3
    source = F.when(supp == 0, "legistar").when(supp == 1, "nyc-city-record").otherwise("press")
    per = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.max("l_extendedprice").alias("price"), F.bool_or(F.col("l_returnflag") == "R").alias("target"), F.datediff(F.max(day), F.min(day)).alias("span"),
        F.datediff(F.lit("1998-12-01").cast("date"), F.max(day)).alias("idle"), F.bool_and(F.col("l_linestatus") == "F").alias("pen"), F.max(E.source_share(source)).alias("source"),
    )
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus", "o_orderpriority")
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    score, _ = E.significance(
        amount=F.col("price") * 1000, private=F.col("o_custkey") % 3 != 0, represented=F.col("o_custkey") % 2 == 0, stage=F.when(s == "F", "approved").when(s == "O", "filed").otherwise("stalled"),
        records=F.col("n"), span_days=F.when(F.col("n") >= 2, F.col("span")), venue=F.when(p == "1-URGENT", "Theme Park").when(p == "2-HIGH", "Hotel").when(p == "3-MEDIUM", "Mixed-Use Development"),
        watched=F.col("target"), source=F.col("source"), idle_days=F.col("idle"), transactions=F.col("pen"),
    )
    return per.join(o, "l_orderkey").select("l_orderkey", score.alias("score"))
