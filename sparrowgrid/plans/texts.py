"""Text queries: whole words, cascades, keys, money, dates, urls, JSON and HTML rows."""

from pyspark.sql import functions as F

from sparrowgrid.functions import predicates as P
from sparrowgrid.functions import rules
from sparrowgrid.functions import text as X
from sparrowgrid.plans.registry import query
from sparrowgrid.session import read, read_spread


@query(
    "whole_word_hits",
    r"""SELECT doc_id, CAST(regexp_matches(text, '(?i)\bthe\b') AS INTEGER) + CAST(regexp_matches(text, '(?i)\band\b') AS INTEGER) + CAST(regexp_matches(text, '(?i)\bder\b') AS INTEGER) AS hits FROM documents""",
)
def whole_word_hits(spark, sf_dir):
    """How many of the listed words a text holds as whole words."""
    return read_spread(spark, sf_dir, "documents").select("doc_id", F.size(P.word_hits("text", ["the", "and", "der"])).alias("hits"))


@query(
    "keyword_prefilter",
    r"""SELECT doc_id FROM documents WHERE CAST(regexp_matches(text, '(?i)\bof\b') AS INT) + CAST(regexp_matches(text, '(?i)\bin\b') AS INT) + CAST(regexp_matches(text, '(?i)\bto\b') AS INT) + CAST(regexp_matches(text, '(?i)\bde\b') AS INT) >= 3""",
)
def keyword_prefilter(spark, sf_dir):
    """Documents with three whole-word keywords or more."""
    return read_spread(spark, sf_dir, "documents").where(F.size(P.word_hits("text", ["of", "in", "to", "de"])) >= 3).select("doc_id")


@query(
    "rule_cascade_reason",
    r"""SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)\bgreen\b') THEN 'excluded' WHEN regexp_matches(p_name, '(?i)\bwidget\b') THEN 'strong'
        WHEN regexp_matches(p_name, '(?i)\b(small|large)\b') AND regexp_matches(p_name, '(?i)\b(ring|gear)\b') THEN 'weak+action' WHEN regexp_matches(p_name, '(?i)\bblue\b') THEN 'deal'
        WHEN regexp_matches(p_name, '(?i)\b(small|large)\b') THEN 'weak-without-action' ELSE 'no-match' END AS reason FROM part""",
)
def rule_cascade_reason(spark, sf_dir):
    """The admission gate with its reason: the first rule that holds."""
    gate = rules.gate("p_name", ["widget"], ["small", "large"], ["ring", "gear"], ["blue"], ["green"])
    return read(spark, sf_dir, "part").select("p_partkey", gate["reason"].alias("reason"))


@query(
    "stage_keywords",
    r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\blicensed\b') THEN 'permitted' WHEN regexp_matches(text, '(?i)\btoken\b') THEN 'approved' ELSE 'filed' END AS stage FROM documents""",
)
def stage_keywords(spark, sf_dir):
    """The most advanced stage whose words a text holds."""
    return read(spark, sf_dir, "documents").select("doc_id", rules.keyword_rules("text", [("permitted", ["licensed"]), ("approved", ["token"])], "filed").alias("stage"))


@query(
    "stage_transitions",
    """WITH r AS (SELECT o_custkey, o_orderpriority, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders),
         s AS (SELECT CASE o_orderpriority WHEN '5-LOW' THEN 'filed' WHEN '4-NOT SPECIFIED' THEN 'hearing scheduled' WHEN '3-MEDIUM' THEN 'approved' WHEN '2-HIGH' THEN 'operating' ELSE 'dormant' END AS t,
           CASE before WHEN '5-LOW' THEN 'filed' WHEN '4-NOT SPECIFIED' THEN 'hearing scheduled' WHEN '3-MEDIUM' THEN 'approved' WHEN '2-HIGH' THEN 'operating' ELSE 'dormant' END AS f FROM r WHERE before IS NOT NULL AND before <> o_orderpriority),
         k AS (SELECT list_position(['filed', 'hearing scheduled', 'approved', 'permitted', 'under construction', 'operating'], f) AS a, list_position(['filed', 'hearing scheduled', 'approved', 'permitted', 'under construction', 'operating'], t) AS b FROM s)
       SELECT CASE WHEN a IS NULL OR b IS NULL OR a = 0 OR b = 0 THEN 'liveness' WHEN b > a THEN 'advanced' ELSE 'corrected' END AS kind, count(*) AS n FROM k GROUP BY 1""",
)
def stage_transitions(spark, sf_dir):
    """Changes of stage by kind: a rung up, a rung down, or a verdict about silence."""
    from pyspark.sql import Window

    c = F.col("o_orderpriority")
    stage = F.when(c == "5-LOW", "filed").when(c == "4-NOT SPECIFIED", "hearing scheduled").when(c == "3-MEDIUM", "approved").when(c == "2-HIGH", "operating").otherwise("dormant")
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", stage.alias("stage"))
    pairs = rows.select("stage", F.lag("stage").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("before")).where("before <> stage")
    return pairs.groupBy(rules.transition("before", "stage").alias("kind")).agg(F.count("*").alias("n"))


@query(
    "normalize_entity",
    """SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS entity, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer""",
)
def normalize_entity(spark, sf_dir):
    """Entity keys and slugs."""
    return read(spark, sf_dir, "customer").select("c_custkey", X.entity_key(F.concat("c_name", F.lit(", Inc. (HQ); Other LLC"))).alias("entity"), X.slug("c_name").alias("slug"))


@query(
    "extract_money_max",
    """SELECT l_orderkey, max(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 1000000 ELSE l_quantity * 1000 END) AS largest FROM lineitem GROUP BY 1""",
)
def extract_money_max(spark, sf_dir):
    """The largest figure stated in a project's texts."""
    said = F.concat(F.lit("a budget of $"), F.format_string("%d", F.col("l_quantity").cast("long")), F.when(F.col("l_linenumber") % 2 == 0, " million").otherwise(",000"), F.lit(" and $5"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", X.largest_money(said).alias("m")).groupBy("l_orderkey").agg(F.max("m").alias("largest"))


@query(
    "extract_iso_dates",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE)::VARCHAR AS first_date, CAST(o_orderdate + INTERVAL 40 DAY AS DATE)::VARCHAR AS last_date, 2 AS n FROM orders""",
)
def extract_iso_dates(spark, sf_dir):
    """The days a text names, in order; impossible ones are left out."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    text = F.concat(F.lit("hearing "), day(F.col("o_orderdate") + F.expr("interval 40 days")), F.lit(", filed "), day("o_orderdate"), F.lit(" (not 1999-02-31, nor "), day("o_orderdate"), F.lit(")"))
    dates = X.iso_dates("text")
    return read(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")).select("o_orderkey", dates[0].cast("string").alias("first_date"), F.element_at(dates, -1).cast("string").alias("last_date"), F.size(dates).alias("n"))


@query(
    "url_host",
    r"""SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/:?#]+)', 1), '^www\.', '') AS host,
        regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '[?&](utm_[a-z]+|ref)=[^&]*', '', 'g'), '/$', '') AS canonical FROM pages""",
)
def url_host(spark, sf_dir):
    """Hosts and canonical urls."""
    return read(spark, sf_dir, "pages").select("page_id", X.host_of("url").alias("host"), X.canonical_url("url").alias("canonical"))


@query("canonical_duplicates", r"""WITH c AS (SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/:?#]+)', 1), '^www\.', '') AS host FROM pages)
        SELECT host, count(*) AS n, min(page_id) AS kept FROM c GROUP BY 1 HAVING count(*) > 1""")
def canonical_duplicates(spark, sf_dir):
    """Pages that share a canonical key, and which stays."""
    return read(spark, sf_dir, "pages").groupBy(X.host_of("url").alias("host")).agg(F.count("*").alias("n"), F.min("page_id").alias("kept")).where("n > 1")


@query("json_props_fields", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(*) AS n FROM events GROUP BY 1")
def json_props_fields(spark, sf_dir):
    """Fields of JSON strings by a declared schema."""
    rows = read(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return rows.groupBy("event_type").agg(F.sum("p.k").alias("k_sum"), F.count("*").alias("n"))


@query("candidate_hash", "SELECT doc_id, substr(sha1(source || chr(10) || lang || chr(10) || text), 1, 16) AS hash FROM documents")
def candidate_hash(spark, sf_dir):
    """Short stable hashes of candidates."""
    return read(spark, sf_dir, "documents").select("doc_id", X.sha_key("source", "lang", "text").alias("hash"))


@query("scrubbed_text", r"""SELECT doc_id, substr(regexp_replace(text, '(?i)\b(token|secret|password|api[_-]?key|authorization)\b(\s*[=:]\s*)\S+', '\1\2[redacted]', 'g'), 1, 500) AS text FROM documents""")
def scrubbed_text(spark, sf_dir):
    """Texts for the log: secrets masked, length bounded."""
    return read(spark, sf_dir, "documents").select("doc_id", X.scrub("text").alias("text"))


@query(
    "levenshtein_pairs",
    """WITH n AS (SELECT DISTINCT p_name || ' ' || p_brand AS name FROM part), x AS (SELECT name, split_part(name, ' ', 1) AS block FROM n WHERE length(name) >= 10)
       SELECT a.name AS a, b.name AS b, round(1 - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name)), 6) AS similarity
       FROM x a JOIN x b ON a.block = b.block AND a.name < b.name WHERE 1 - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name)) >= 0.9""",
)
def levenshtein_pairs(spark, sf_dir):
    """Similar names within a block."""
    from sparrowgrid.operators.resolve import fuzzy_pairs

    names = read(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("name")).distinct()
    return fuzzy_pairs(names.withColumn("id", F.col("name")), "id", "name", F.split("name", " ")[0]).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(
    "array_operations",
    """SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS flags, array_to_string(list_sort(list_intersect(list(l_returnflag), ['A', 'R'])), ',') AS kept FROM lineitem GROUP BY 1""",
)
def array_operations(spark, sf_dir):
    """Distinct, sorted, intersected arrays."""
    per = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("flags"))
    return per.select("l_orderkey", F.array_join("flags", ",").alias("flags"), F.array_join(F.array_sort(F.array_intersect("flags", F.array(F.lit("A"), F.lit("R")))), ",").alias("kept"))


@query(
    "html_rows",
    """WITH p AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages)
       SELECT page_id, unnest(h) AS href, unnest(t) AS label FROM p""",
)
def html_rows(spark, sf_dir):
    """Links of every page's navigation, one row each."""
    from sparrowgrid.sources.readers import html_rows as rows_of

    return rows_of(read(spark, sf_dir, "pages").select("page_id", "html"), r'<li><a href="([^"]*)">([^<]*)</a>', ["href", "label"])


@query(
    "press_facts",
    r"""SELECT doc_id, len(regexp_extract_all(text, '(?i)\b[0-9]+ (rooms|floors|seats|acres)\b')) AS facts, len(regexp_extract_all(text, '\+?[0-9][0-9 ()-]{8,}[0-9]')) AS phones FROM documents""",
)
def press_facts(spark, sf_dir):
    """Quantities and phone numbers a text states."""
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        F.regexp_count("text", F.lit(r"(?i)\b[0-9]+ (rooms|floors|seats|acres)\b")).cast("long").alias("facts"),
        F.regexp_count("text", F.lit(r"\+?[0-9][0-9 ()-]{8,}[0-9]")).cast("long").alias("phones"),
    )


@query("sentences", r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!?][ \n]+|\n+'), lambda x: trim(x) <> '')) AS n FROM documents""")
def sentences(spark, sf_dir):
    """How many sentences and lines a text has."""
    parts = F.split("text", r"[.!?][ \n]+|\n+")
    return read(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(parts, lambda x: F.trim(x) != "")).cast("long").alias("n"))
