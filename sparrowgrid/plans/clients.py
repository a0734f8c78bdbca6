"""Queries on clients, memberships, ledgers and what reports leave out."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparrowgrid.operators import ranking as K
from sparrowgrid.operators import register as R
from sparrowgrid.operators import writes as W
from sparrowgrid.plans.registry import query
from sparrowgrid.session import read


@query(
    "parent_history",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER w AS INT) AS place, lead(l_returnflag) OVER w AS before FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey)""",
)
def parent_history(spark, sf_dir):
    """Every project's events, newest first, each with the value before it."""
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_shipdate"), "l_linenumber", "l_partkey", "l_suppkey")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).alias("place"), F.lead("l_returnflag").over(w).alias("before"))


_MEMBERS = "m AS (SELECT o_custkey AS client, o_orderkey AS project, CASE o_orderkey % 4 WHEN 0 THEN 'proposed' WHEN 1 THEN 'included' WHEN 2 THEN 'excluded' ELSE 'included' END AS status FROM orders)"


def _members(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("client"), F.col("o_orderkey").alias("project"), F.when(k == 0, "proposed").when(k == 2, "excluded").otherwise("included").alias("status"))


@query(
    "client_view",
    f"""WITH {_MEMBERS}, l AS (SELECT l_orderkey, count(*) AS records, max(l_shipdate) AS newest FROM lineitem GROUP BY 1)
       SELECT client, count(*) AS projects, CAST(sum(coalesce(records, 0)) AS BIGINT) AS records, CAST(max(newest) AS DATE)::VARCHAR AS newest, count(*) FILTER (WHERE status = 'proposed') AS unconfirmed
       FROM m LEFT JOIN l ON l_orderkey = project WHERE status <> 'excluded' GROUP BY 1""",
)
def client_view(spark, sf_dir):
    """What each client sees: projects that aren't excluded, their records, the newest day, and how many wait for a decision."""
    per = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("project")).agg(F.count("*").alias("records"), F.max("l_shipdate").alias("newest"))
    seen = _members(spark, sf_dir).where("status <> 'excluded'").join(per, "project", "left")
    return seen.groupBy("client").agg(
        F.count("*").alias("projects"), F.sum(F.coalesce("records", F.lit(0))).alias("records"), F.max("newest").cast("date").cast("string").alias("newest"), F.count_if(F.col("status") == "proposed").alias("unconfirmed")
    )


@query(
    "scope_projects",
    f"""WITH {_MEMBERS} SELECT o_orderkey AS project, c_mktsegment AS segment, m.status FROM orders JOIN customer ON c_custkey = o_custkey JOIN m ON m.project = o_orderkey
       WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O') AND m.status <> 'excluded'""",
)
def scope_projects(spark, sf_dir):
    """Projects inside a client's scope (each axis may be met by another record) that it hasn't excluded."""
    from sparrowgrid.operators.scopes import per_axis

    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project"), "l_returnflag", "l_linestatus")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project"), F.col("o_custkey").alias("c_custkey"))
    scoped = per_axis(rows, items, "project", {"l_returnflag": ["R"], "l_linestatus": ["O"], "venue": []})
    mine = _members(spark, sf_dir).where("status <> 'excluded'").select("project", "status")
    return scoped.join(mine, "project").join(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), "c_custkey").select("project", "segment", "status")


@query(
    "party_lookup",
    """WITH p AS (SELECT 'customer' AS place, c_custkey AS id, lower(replace(c_name, '#', ' ')) AS key FROM customer UNION ALL SELECT 'supplier', s_suppkey, lower(replace(replace(s_name, 'Supplier', 'Customer'), '#', ' ')) FROM supplier)
       SELECT key, count(*) AS hits, string_agg(DISTINCT place, ',' ORDER BY place) AS places FROM p GROUP BY 1 HAVING count(DISTINCT place) > 1""",
)
def party_lookup(spark, sf_dir):
    """Parties that several tables name."""
    key = lambda c: F.lower(F.regexp_replace(c, "#", " "))
    c = read(spark, sf_dir, "customer").select(F.lit("customer").alias("place"), key(F.col("c_name")).alias("key"))
    s = read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("place"), key(F.regexp_replace("s_name", "Supplier", "Customer")).alias("key"))
    per = c.unionByName(s).groupBy("key").agg(F.count("*").alias("hits"), F.sort_array(F.collect_set("place")).alias("p"))
    return per.where(F.size("p") > 1).select("key", "hits", F.array_join("p", ",").alias("places"))


@query("facet_fallback", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def facet_fallback(spark, sf_dir):
    """A facet from its stored counts, or from the rows where none are stored."""
    rows = read(spark, sf_dir, "orders")
    stored = rows.where(F.lit(False)).select(F.col("o_orderpriority").alias("value"), F.lit(0).cast("long").alias("n"))
    return R.facet_or(stored, rows, "o_orderpriority")


@query(
    "held_out_counts",
    """SELECT CASE WHEN l_returnflag = 'N' THEN 'not a filing' WHEN l_quantity < 5 THEN 'too small' WHEN l_discount > 0.08 THEN 'discounted' ELSE 'shown' END AS why, count(*) AS n FROM lineitem GROUP BY 1""",
)
def held_out_counts(spark, sf_dir):
    """What a report leaves out, by the first rule that holds it back."""
    rules = [("not a filing", F.col("l_returnflag") == "N"), ("too small", F.col("l_quantity") < 5), ("discounted", F.col("l_discount") > 0.08)]
    return R.held_out(read(spark, sf_dir, "lineitem"), rules)


@query(
    "probe_scorecard",
    """WITH p AS (SELECT p_brand, p_size > 20 AS expected, p_retailprice > 1200 AS got, p_size > 45 AS must FROM part)
       SELECT p_brand, count(*) AS probes, count(*) FILTER (WHERE expected = got) AS right_, count(*) FILTER (WHERE must AND NOT got) AS missed, round(count(*) FILTER (WHERE expected = got) * 1.0 / count(*), 6) AS share FROM p GROUP BY 1""",
)
def probe_scorecard(spark, sf_dir):
    """Probes of a gate by group: how many came out as expected, and which that must be captured weren't."""
    rows = read(spark, sf_dir, "part").select("p_brand", (F.col("p_size") > 20).alias("expected"), (F.col("p_retailprice") > 1200).alias("got"), (F.col("p_size") > 45).alias("must"))
    one = R.census(rows, ["p_brand"], right_=F.count_if(F.col("expected") == F.col("got")), missed=F.count_if(F.col("must") & ~F.col("got")))
    return one.select("p_brand", F.col("n").alias("probes"), "right_", "missed", F.round(F.col("right_") / F.col("n"), 6).alias("share"))


@query(
    "coverage_notes",
    """WITH c AS (SELECT n_name AS market, o_orderstatus AS state, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)
       SELECT market, state, n, round(n * 100.0 / sum(n) OVER (PARTITION BY market), 4)::DOUBLE AS percent FROM c""",
)
def coverage_notes(spark, sf_dir):
    """Each market's states with their shares."""
    c = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("market"))
    per = R.census(read(spark, sf_dir, "orders").join(c, "o_custkey"), ["market", F.col("o_orderstatus").alias("state")])
    return per.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("market")), 4))


@query(
    "ranked_alternatives",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'filing' WHEN o_totalprice > 100000 THEN 'press' WHEN o_custkey % 2 = 0 THEN 'manual' END AS chosen FROM orders""",
)
def ranked_alternatives(spark, sf_dir):
    """Of several statements of one field the one of the best source."""
    told = F.array(
        F.when(F.col("o_custkey") % 2 == 0, F.struct(F.lit("manual").alias("source"))), F.when(F.col("o_totalprice") > 100000, F.struct(F.lit("press").alias("source"))), F.when(F.col("o_orderstatus") == "F", F.struct(F.lit("filing").alias("source")))
    )
    rows = read(spark, sf_dir, "orders")
    best = K.best_alternative(rows.select("o_orderkey", F.inline(F.array_compact(told))), "o_orderkey", "source", ("filing", "press", "manual"))
    return rows.select("o_orderkey").join(best, "o_orderkey", "left").select("o_orderkey", F.col("source").alias("chosen"))


@query(
    "detach_attach",
    """SELECT o_orderkey AS record, CASE o_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 7 ELSE o_custkey END AS project_id, CASE o_custkey % 3 WHEN 0 THEN 'detached' WHEN 1 THEN 'manual' ELSE 'site' END AS cluster_reason FROM orders""",
)
def detach_attach(spark, sf_dir):
    """Records moved by hand: out of their project for good, or into another one."""
    rows = read(spark, sf_dir, "orders")
    stored = rows.select(F.col("o_orderkey").alias("record"), F.col("o_custkey").alias("project_id"), F.lit("site").alias("cluster_reason"))
    moves = rows.where("o_custkey % 3 < 2").select(F.col("o_orderkey").alias("record"), F.when(F.col("o_custkey") % 3 == 1, F.lit(7).cast("long")).alias("to"))
    return W.move_records(stored, moves, "record")


@query(
    "membership_upsert",
    f"""WITH {_MEMBERS} SELECT client, project, CASE WHEN project % 8 = 0 THEN 'included' WHEN project % 8 = 2 AND status = 'excluded' THEN 'excluded' ELSE status END AS status, project % 8 = 0 AS changed FROM m""",
)
def membership_upsert(spark, sf_dir):
    """Decisions over proposals: a decision replaces a proposal, a proposal never a decision."""
    stored = _members(spark, sf_dir)
    decided = stored.where("project % 8 = 0").select("client", "project", F.lit("included").alias("status"))
    proposed = stored.where("project % 8 = 2").select("client", "project", F.lit("proposed").alias("status"))
    return W.upsert_membership(stored, decided.unionByName(proposed), ["client", "project"])


@query(
    "client_create",
    """WITH s AS (SELECT c_custkey AS id, lower(c_mktsegment) || ' ' || (c_custkey % 40) AS identity FROM customer WHERE c_custkey % 40 < 20),
         f AS (SELECT identity, min(id) AS id FROM s GROUP BY 1), w AS (SELECT DISTINCT lower(c_mktsegment) || ' ' || (c_custkey % 40) AS identity FROM customer)
       SELECT w.identity, f.id, f.id IS NULL AS created FROM w LEFT JOIN f USING (identity)""",
)
def client_create(spark, sf_dir):
    """Clients found by their identity, or made."""
    name = F.concat(F.initcap("c_mktsegment"), F.lit("  "), (F.col("c_custkey") % 40).cast("string"))
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), name.alias("name"))
    return W.find_or_create(rows.where("id % 40 < 20"), rows.select("name"), "id", "name")


@query(
    "run_ledger",
    """WITH r AS (SELECT o_orderpriority AS unit, CAST(o_orderdate AS DATE) AS day, count(*) AS fetched, count(*) FILTER (WHERE o_orderstatus = 'F') AS kept FROM orders GROUP BY 1, 2)
       SELECT unit, count(*) AS runs, CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(kept) AS BIGINT) AS kept, count(*) FILTER (WHERE kept = 0) AS empty FROM r GROUP BY 1""",
)
def run_ledger(spark, sf_dir):
    """Runs appended to the health ledger, read back and summed by unit."""
    runs = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("unit"), F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("fetched"), F.count_if(F.col("o_orderstatus") == "F").alias("kept"))
    ledger = W.append_ledger(None, runs, ["unit", "day"])
    return ledger.groupBy("unit").agg(F.count("*").alias("runs"), F.sum("fetched").alias("fetched"), F.sum("kept").alias("kept"), F.count_if(F.col("kept") == 0).alias("empty"))


@query(
    "plain_upsert",
    """WITH s AS (SELECT p_partkey AS url, p_name AS title FROM part WHERE p_partkey % 3 > 0), n AS (SELECT p_partkey AS url, p_brand AS title FROM part WHERE p_partkey % 3 < 2)
       SELECT coalesce(s.url, n.url) AS url, coalesce(n.title, s.title) AS title FROM s FULL JOIN n ON s.url = n.url""",
)
def plain_upsert(spark, sf_dir):
    """New rows over stored ones, by url, without any guard."""
    part = read(spark, sf_dir, "part")
    stored = part.where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("url"), F.col("p_name").alias("title"))
    new = part.where("p_partkey % 3 < 2").select(F.col("p_partkey").alias("url"), F.col("p_brand").alias("title"))
    return W.plain_upsert(stored, new, "url")


@query(
    "inventory_state",
    """SELECT user_id, event_type, max(ts)::VARCHAR AS last_seen, min(ts)::VARCHAR AS first_seen, count(*) AS seen FROM events GROUP BY 1, 2""",
)
def inventory_state(spark, sf_dir):
    """The last time each document of an inventory was seen: two walks folded into the stored state."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    keys = ["user_id", "event_type"]
    state = W.last_seen(None, rows.where("ts < timestamp_ntz'2024-01-10'"), keys, "ts")
    state = W.last_seen(state, rows.where("ts >= timestamp_ntz'2024-01-10'"), keys, "ts")
    text = lambda c: F.regexp_replace(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    whole = lambda c: F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd HH:mm:ss")).otherwise(text(c))
    return state.select(*keys, whole("last_seen").alias("last_seen"), whole("first_seen").alias("first_seen"), "seen")


@query(
    "referral_sections",
    """WITH p AS (SELECT o_orderkey, o_orderstatus, c_name FROM orders JOIN customer ON c_custkey = o_custkey),
         a AS (SELECT l_orderkey, count(*) AS records, count(*) FILTER (WHERE l_returnflag = 'N') AS press, count(DISTINCT l_suppkey) AS people, CAST(max(l_shipdate) AS DATE)::VARCHAR AS newest FROM lineitem GROUP BY 1)
       SELECT o_orderkey, 'cover' AS section, c_name || ': ' || o_orderstatus AS line FROM p UNION ALL SELECT o_orderkey, 'people', coalesce(people, 0) || ' parties' FROM p LEFT JOIN a ON l_orderkey = o_orderkey
       UNION ALL SELECT o_orderkey, 'press', press || ' of ' || records || ' records' FROM p JOIN a ON l_orderkey = o_orderkey WHERE press > 0
       UNION ALL SELECT o_orderkey, 'coverage', 'newest ' || newest FROM p JOIN a ON l_orderkey = o_orderkey""",
)
def referral_sections(spark, sf_dir):
    """The sections of every project's own document; sections without anything to say are left out."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    per = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("records"), F.count_if(F.col("l_returnflag") == "N").alias("press"), F.countDistinct("l_suppkey").alias("people"), F.max("l_shipdate").cast("date").cast("string").alias("newest")
    )
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(c, "o_custkey").join(per, "o_orderkey", "left")
    line = lambda section, *said: F.struct(F.lit(section).alias("section"), F.concat(*said).alias("line"))
    lines = [
        line("cover", "c_name", F.lit(": "), "o_orderstatus"), line("people", F.coalesce("people", F.lit(0)), F.lit(" parties")),
        F.when(F.col("press") > 0, line("press", "press", F.lit(" of "), "records", F.lit(" records"))), F.when(F.col("newest").isNotNull(), line("coverage", F.lit("newest "), "newest")),
    ]
    return rows.select("o_orderkey", F.inline(F.array_compact(F.array(*lines))))


@query(
    "rolling_windows",
    """SELECT event_type, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-17 12:00:00') AS d1, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-11 12:00:00') AS d7, count(*) FILTER (WHERE ts >= TIMESTAMP '2023-12-19 12:00:00') AS d30 FROM events GROUP BY 1""",
)
def rolling_windows(spark, sf_dir):
    """Events of the last day, week and month, in one pass."""
    from datetime import datetime

    from sparrowgrid.functions import periods

    now, ts = datetime(2024, 1, 18, 12), F.col("ts").cast("timestamp")
    counts = {n: F.count_if(periods.resolve(t, now).holds(ts)) for n, t in (("d1", "24h"), ("d7", "7d"), ("d30", "30d"))}
    return R.census(read(spark, sf_dir, "events"), ["event_type"], **counts).drop("n")


@query("lane_counters", "SELECT event_type AS lane, count(*) AS n, count(*) FILTER (WHERE value > 50) AS matched, round(sum(value), 2) AS total FROM events GROUP BY 1")
def lane_counters(spark, sf_dir):
    """A run's counters by lane."""
    return R.census(read(spark, sf_dir, "events").withColumnRenamed("event_type", "lane"), ["lane"], matched=F.count_if(F.col("value") > 50), total=F.round(F.sum("value"), 2))


@query(
    "attach_on_write",
    """WITH w AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 = 0), p AS (SELECT l_orderkey AS id, min(l_suppkey) AS project FROM lineitem GROUP BY 1), k AS (SELECT project, count(*) AS n FROM p GROUP BY 1)
       SELECT w.id, CASE WHEN p.project IS NULL THEN 'unclustered' WHEN n = 1 THEN 'created' ELSE 'attached' END AS outcome FROM w LEFT JOIN p USING (id) LEFT JOIN k USING (project)""",
)
def attach_on_write(spark, sf_dir):
    """What clustering did with each record just written: attached, created a project, or nothing."""
    written = read(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("id"))
    placed = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_suppkey").alias("component"))
    return W.write_outcomes(written, placed, "id", "component")


@query("scored_records", "SELECT doc_id, n_chars % 101 AS score, CASE WHEN n_chars % 101 >= 70 THEN 'high' WHEN n_chars % 101 >= 40 THEN 'medium' ELSE 'low' END AS tier FROM documents")
def scored_records(spark, sf_dir):
    """A pluggable scorer over batches of rows, with a deterministic stub, and its tiers."""
    from sparrowgrid.operators.scoring import length_scorer, scored, tier

    return scored(read(spark, sf_dir, "documents"), length_scorer("n_chars"), ["n_chars"]).select("doc_id", "score", tier("score").alias("tier"))
