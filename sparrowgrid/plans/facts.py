"""Queries on facts that texts state, and on names, labels and log fields."""

from pyspark.sql import functions as F

from sparrowgrid.functions import facts as X
from sparrowgrid.functions import text as S
from sparrowgrid.plans.registry import query
from sparrowgrid.session import read, read_spread


def _articles(spark, sf_dir):
    n = lambda c, add, mod: (F.col(c) % mod + add).cast("string")
    said = F.concat(
        F.lit("Acme Towers will have "), n("o_custkey", 2, 500), F.lit(" hotel rooms. It rises "), n("o_orderkey", 2, 100), F.lit(" storeys over "), n("o_custkey", 1, 90),
        F.lit(" acres.\nThe cost is $"), n("o_orderkey", 1, 400), F.lit(" million, not $200, for a 1,5"), n("o_custkey", 10, 90), F.lit("-seat hall"),
    )
    return read_spread(spark, sf_dir, "orders").select("o_orderkey", said.alias("said"))


@query(
    "press_fact_rows",
    """WITH a AS (SELECT o_orderkey, o_custkey % 500 + 2 AS r, o_orderkey % 100 + 2 AS f, o_custkey % 90 + 1 AS s, o_orderkey % 400 + 1 AS m, 1500 + o_custkey % 90 + 10 AS h FROM orders)
       SELECT o_orderkey, 'rooms' AS kind, r || ' hotel rooms' AS display, r::DOUBLE AS value, 'Acme Towers will have ' || r || ' hotel rooms.' AS sentence FROM a
       UNION ALL SELECT o_orderkey, 'floors', f || ' storeys', f, 'It rises ' || f || ' storeys over ' || s || ' acres.' FROM a
       UNION ALL SELECT o_orderkey, 'acres', s || ' acres', s, 'It rises ' || f || ' storeys over ' || s || ' acres.' FROM a
       UNION ALL SELECT o_orderkey, 'money', '$' || m || ' million', m * 1e6, 'The cost is $' || m || ' million, not $200, for a 1,' || (h - 1000) || '-seat hall' FROM a
       UNION ALL SELECT o_orderkey, 'seats', '1,' || (h - 1000) || '-seat', h, 'The cost is $' || m || ' million, not $200, for a 1,' || (h - 1000) || '-seat hall' FROM a""",
)
def press_fact_rows(spark, sf_dir):
    """Every fact of every article with its value and sentence; small amounts and bare words are none."""
    return X.fact_rows(_articles(spark, sf_dir), "o_orderkey", "said").drop("place")


@query("invented_facts", "SELECT 0::BIGINT AS invented")
def invented_facts(spark, sf_dir):
    """How many facts their own text doesn't hold: none."""
    articles = _articles(spark, sf_dir)
    facts = X.fact_rows(articles, "o_orderkey", "said", keep=["said"])
    return X.invented(facts, "said").agg(F.count("*").alias("invented"))


@query(
    "entry_facts",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS facts FROM orders""",
)
def entry_facts(spark, sf_dir):
    """Facts that are about the project: their sentence names it or one of its parties."""
    articles = _articles(spark, sf_dir)
    name = F.when(F.col("o_orderkey") % 2 == 0, "The Acme Towers Hotel Project").otherwise("North River Park, LLC")
    terms = articles.withColumn("terms", X.attribution_terms(name, F.when(F.col("o_orderkey") % 2 == 0, F.lit("Acme Towers, LLC"))))
    facts = X.fact_rows(terms, "o_orderkey", "said", keep=["terms"])
    kept = X.entry_facts(facts, "o_orderkey", "terms").groupBy("o_orderkey").agg(F.count("*").alias("n"))
    return articles.select("o_orderkey").join(kept, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).cast("int").alias("facts"))


@query(
    "filing_lines",
    """SELECT p_partkey, 'zone' AS kind, p_name AS display, NULL::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'units', p_size || ' units', p_size FROM part
       UNION ALL SELECT p_partkey, 'money', '$1,200.5', 1200.5 FROM part""",
)
def filing_lines(spark, sf_dir):
    """Labelled lines of filings."""
    said = F.concat(F.lit("ZONE:  "), "p_name", F.lit("\nUnits # "), "p_size", F.lit(" units\nFee: $1,200.5\nno label here"))
    rows = read(spark, sf_dir, "part").select("p_partkey", said.alias("said"))
    found = X.labelled_lines("said", {"zone": ("zone",), "units": ("units",), "money": ("fee", "price")})
    return rows.select("p_partkey", F.inline(found)).select("p_partkey", "kind", "display", "value")


@query(
    "filing_fact_merge",
    """WITH f AS (SELECT DISTINCT p_brand, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE split_part(p_name, ' ', 1) END AS d FROM part)
       SELECT p_brand, d AS display FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.p_brand = a.p_brand AND starts_with(b.d, a.d || ' '))""",
)
def filing_fact_merge(spark, sf_dir):
    """Of a kind's wordings those that begin no longer one."""
    rows = read(spark, sf_dir, "part").select("p_brand", F.lit("zone").alias("kind"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.split("p_name", " ")[0]).alias("display"), F.lit(None).cast("double").alias("value"))
    return X.merged_filing_facts(rows, "p_brand").select("p_brand", "display")


@query(
    "contact_lines",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 <> 3 THEN c_name END AS applicant, CASE c_custkey % 4 WHEN 1 THEN 'Jane Doe, clerk@city.gov 702-555-0100' WHEN 3 THEN NULL ELSE 'Jane Doe, jane@doe-law.com 702-555-0100' END AS representative,
       CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE 'jane@doe-law.com' END AS email, '702-555-0100' AS phone FROM customer""",
)
def contact_lines(spark, sf_dir):
    """Owner, representative, mail and phone of filings; an agency's mailbox is nobody's."""
    k = F.col("c_custkey") % 4
    said = F.concat(
        F.when(k == 3, "").otherwise(F.concat(F.lit("Owner: "), "c_name", F.lit("\n"))),
        F.when(k == 1, "Agent: Jane Doe, clerk@city.gov 702-555-0100").otherwise("Agent: Jane Doe, jane@doe-law.com 702-555-0100"),
        F.lit("\nClerk mail clerk@city.gov"),
    )
    rows = read_spread(spark, sf_dir, "customer").select("c_custkey", said.alias("said"))
    found = X.contacts("said")
    return rows.select("c_custkey", found.alias("c")).select("c_custkey", "c.applicant", "c.representative", "c.email", "c.phone")


@query(
    "entity_keys",
    """SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'walt disney parks resorts u s' WHEN 1 THEN 'kulik river capital' WHEN 2 THEN 'holland hart' WHEN 3 THEN 'anaheim real estate' WHEN 4 THEN 'city of reno' ELSE 'm d 57 box st' END AS entity,
       s_suppkey % 6 = 4 AS public FROM supplier""",
)
def entity_keys(spark, sf_dir):
    """First parties as keys: suffixes popped, cut at co-party boundaries only."""
    names = ("Walt Disney Parks and Resorts U.S., Inc.", "KULIK RIVER CAPITAL, LLC", "HOLLAND & HART LLP", "Anaheim Real Estate Partners, LLC, and FCD, LLC", "The City of Reno (NV)", "M&D 57 Box St; Other LLC")
    said = F.element_at(F.array(*map(F.lit, names)), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", S.entity_key(said).alias("entity")).select("s_suppkey", "entity", S.is_generic_party("entity").alias("public"))


@query(
    "people_and_firms",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 3 THEN 'Jane Doe' END AS person, CASE WHEN s_suppkey % 4 <> 2 THEN CASE s_suppkey % 4 WHEN 3 THEN 'Kaempfer Crowell Group' ELSE 'Doe Partners, LLC' END END AS firm FROM supplier""",
)
def people_and_firms(spark, sf_dir):
    """Person and firm of a representative's line."""
    said = F.element_at(F.array(*map(F.lit, ("Jane Doe, Doe Partners, LLC", "Doe Partners, LLC - Jane Doe", "Jane Doe", "Kaempfer Crowell Group"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", S.name_and_firm(said).alias("n")).select("s_suppkey", "n.person", "n.firm")


@query(
    "money_labels",
    """SELECT o_orderkey, CASE WHEN v >= 1e9 THEN '$' || printf('%.1f', v / 1e9) || 'bn' WHEN v >= 1e6 THEN '$' || printf('%.1f', v / 1e6) || 'm' ELSE '$' || CAST(floor(v / 1000 + 0.5) AS BIGINT) || 'k' END AS label,
       CASE WHEN v < 1e5 THEN 0 ELSE floor(least(1, greatest(0, (log10(v) - 5) / 4)) * 10 * 10 + 0.5) / 10 END AS points
       FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN (o_custkey % 90 + 1) * 1e3 WHEN 1 THEN (o_custkey % 900 + 1) * 1e6 ELSE (o_custkey % 9 + 1) * 1e9 END AS v FROM orders)""",
)
def money_labels(spark, sf_dir):
    """Amounts read from text, as labels and as points on the log scale."""
    k, n = F.col("o_orderkey") % 3, F.col("o_custkey")
    said = F.concat(F.lit("worth $"), F.when(k == 0, n % 90 + 1).when(k == 1, n % 900 + 1).otherwise(n % 9 + 1), F.when(k == 0, "k").when(k == 1, "mm").otherwise(" billion"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", S.largest_money(said).alias("v"))
    return rows.select("o_orderkey", S.money_label("v").alias("label"), S.money_points(F.col("v")).alias("points"))


@query(
    "text_flags",
    """SELECT n_nationkey, n_nationkey % 3 = 1 AS spanish, CASE n_nationkey % 3 WHEN 0 THEN 'Cafe Munoz Elevee' WHEN 1 THEN 'El hotel de la playa con los jardines y una torre' ELSE 'Cargo of 12,000 metric tonnes, then 900 MT for the north' END AS plain, CASE WHEN n_nationkey % 3 = 2 THEN 12000.0 END AS tonnes FROM nation""",
)
def text_flags(spark, sf_dir):
    """Language, accents and stated volumes."""
    said = F.element_at(F.array(*map(F.lit, ("Café Muñoz Élevée", "El hotel de la playa con los jardines y una torre", "Cargo of 12,000 metric tonnes, then 900 MT for the north"))), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "nation").select("n_nationkey", said.alias("said")).select(
        "n_nationkey", S.is_spanish("said").alias("spanish"), S.deaccent("said").alias("plain"), S.tonnes("said").alias("tonnes")
    )


@query(
    "scrubbed_fields",
    """SELECT r_regionkey, '[redacted]' AS api_key, '[redacted]' AS body, CASE WHEN r_regionkey % 2 = 0 THEN 'https://x.test/a?key=[redacted]&b=1' ELSE '[redacted]' END AS place, r_name AS unit FROM region""",
)
def scrubbed_fields(spark, sf_dir):
    """Log fields with secrets and content masked."""
    place = F.when(F.col("r_regionkey") % 2 == 0, "https://x.test/a?key=abc&b=1").otherwise(F.concat(F.lit("seen "), F.repeat(F.lit("a1B2"), 12)))
    fields = F.create_map(F.lit("API_KEY"), F.lit("s3"), F.lit("body"), F.lit("long text"), F.lit("place"), place, F.lit("unit"), F.col("r_name"))
    rows = read(spark, sf_dir, "region").select("r_regionkey", S.scrub_fields(fields).alias("f"))
    return rows.select("r_regionkey", F.col("f")["API_KEY"].alias("api_key"), F.col("f")["body"].alias("body"), F.col("f")["place"].alias("place"), F.col("f")["unit"].alias("unit"))
