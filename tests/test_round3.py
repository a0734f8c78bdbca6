"""What round 3 found: results on odd rows, and steps that grew faster than their input."""

import re

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from sparrowgrid.operators import dictionary
from sparrowgrid.plans import registry


def by_sql(name, **tables):
    con = duckdb.connect()
    for t, df in tables.items():
        con.register(t, df)
    got = con.execute(registry.ORACLES[name])
    return {tuple(r) for r in got.fetchall()}


def by_spark(spark, name, path, **tables):
    for t, df in tables.items():
        spark.createDataFrame(df).write.parquet(f"{path}/{t}.parquet")
    return {tuple(r) for r in registry.QUERIES[name](spark, str(path)).collect()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_broker_noise_takes_words_as_written(spark, tmp_path):
    said = ["to írañ", "to Iran.", "a l-o-i", "LOI", "éiran", "iran_2", "performance bond", "ſBLC", "Haití", "a colima-b", "mandates", ""]
    docs = pd.DataFrame({"doc_id": range(len(said)), "text": said})
    assert by_spark(spark, "broker_noise", tmp_path, documents=docs) == by_sql("broker_noise", documents=docs)


def test_code_industries_never_broadcasts_exploded_codes(spark):
    rows = spark.createDataFrame([(1, ["12", "9"]), (2, ["7", "9", "12"]), (3, ["7"]), (4, ["", "1299"])], "id int, codes array<string>")
    tree = spark.createDataFrame([("1", "a"), ("12", "c"), ("12", "b"), ("9", "n")], "code string, v string")
    found = dictionary.first_known_code(rows, "id", "codes", tree, "code", "v")
    assert "Broadcast" not in plan(found)
    assert {tuple(r) for r in found.collect()} == {(1, "b"), (2, "n"), (4, "b")}


SF = "/root/testdata/sf0.001"


def copies(spark, name, part):
    """How often a part of a pattern stands in the optimised plan: how often a row's text is read for it."""
    return registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count(part)


def test_related_pairs_are_not_shuffled(spark):
    said = plan(registry.QUERIES["related_reasons"](spark, SF))
    assert "Aggregate" not in said[: said.index("Join")]


def test_neighbours_travel_in_lists(spark):
    said = plan(registry.QUERIES["related_suppliers_shared"](spark, SF))
    top = said[: said.index("Join")]
    assert top.count("Exchange") == 1 and "inline" in top[: top.index("Exchange")]


def test_invented_facts_join_nothing(spark):
    assert "Join" not in plan(registry.QUERIES["invented_facts"](spark, SF))


def test_entry_facts_take_terms_along(spark):
    assert len(re.findall(r"\bSortMergeJoin|\bBroadcastHashJoin", plan(registry.QUERIES["entry_facts"](spark, SF)))) == 1


def test_press_facts_search_only_sentences_that_can_match(spark):
    from sparrowgrid.functions import facts

    assert copies(spark, "press_fact_rows", "Contains") >= len(facts.KINDS)


def test_party_keys_are_made_once(spark):
    assert copies(spark, "party_block", r"\([^)]*\)") == 1 and copies(spark, "party_extraction", r"\([^)]*\)") == 1


def test_contact_lines_are_cut_once(spark):
    assert copies(spark, "contact_lines", "owner/applicant") <= 3


def test_titles_are_cleaned_once_and_records_read_once(spark):
    assert copies(spark, "project_name_ladder", "case planner") == 1 and copies(spark, "project_name_ladder", "Relation [") == 1


def test_outline_items_are_made_once(spark):
    assert copies(spark, "packet_outlines", "call to order") == 1 and copies(spark, "packet_outlines", r"\s*, ") <= 1
