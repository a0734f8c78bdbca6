"""Signals of records, what is suppressed, clusters and reasons, on small fixtures."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparrowgrid.functions import facts, taxonomy
from sparrowgrid.operators import scoring, signals, writes
from sparrowgrid.plans import clusters
from tests.test_whole import replayed

SF = "/root/testdata/sf0.001"

SCHEMA = "id long, title string, body string, url string, market string, location string, source string, stream string, applicant string, representative string, presented_by string, status string, lifecycle string, cluster_reason string"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def rec(id, title="", **more):
    row = {"id": id, "title": title, "stream": "government", "market": "Phoenix", "source": "x"} | more
    return tuple(row.get(c) for c in COLUMNS)


@pytest.fixture(scope="module")
def clustered(spark):
    targets = (signals.Target("Heart Hotel", ("heart hotel",)), signals.Target("OCVibe", ("ocvibe",)))
    rows = [
        rec(1, "Rezoning Z-12-A-1 for a tower"), rec(2, "Continued item", body="see z-12-a-1 and nothing more"),  # one case, title and body
        rec(3, "Works on 4400 North Elm Street, lot one"), rec(4, "More works on 4400 north elm street"),  # one address
        *[rec(10 + k, f"Office filing {'abcd'[k]} sent from 77 Main Plaza today") for k in range(4)],  # an office's address
        rec(20, "A headline about Silver Creek Village now", stream="intelligence"), rec(21, "why Silver Creek Village matters", stream="intelligence"),  # corroborated
        rec(22, "so Lonely Lake Lodge opens", stream="intelligence"),  # one name, one record
        rec(30, "Heart Hotel plans, Z-99-B-1"), rec(31, "OCVibe plans, Z-99-B-1"), rec(32, "Plans again Z-99-B-1"),  # two targets share a case
        rec(40, "Weekly agenda packet"), rec(41, "An item of a thing with its own words", url="http://x/agenda#item3"),
        rec(50, "city-initiated update Z-1-C-1", body="touches z-2-c-1, z-3-c-1 and z-12-a-1"),  # citywide: its title's first case only
        rec(51, "omnibus", body="z-12-a-1 z-2-d-1 z-3-d-1 z-4-d-1"),  # too many cases
        rec(60, "An application by a firm", applicant="Kulik River Capital, LLC"), rec(61, "Another one of theirs", applicant="KULIK RIVER CAPITAL LLC"),
        rec(62, "kulik river capital buys more land", stream="intelligence"),  # the one known entity of the market
        rec(63, "A city filing of some length", applicant="City of Phoenix"),
        rec(64, "Notice of award to them", applicant="Kulik River Capital", body="intent to award as a concession"),
        rec(70, "Dismissed Z-12-A-1", status="dismissed"), rec(71, "Detached Z-12-A-1", cluster_reason="detached"), rec(72, "Retired Z-12-A-1", lifecycle="retired"),
        rec(80, "tiny"), rec(81, "A longer text that says nothing at all", source="jooble"),
        rec(90, "Hearing", body="heard at 500 south grand pkwy, commission chambers, downtown"), rec(91, "Hearing two", body="also at 500 south grand pkwy, commission chambers"),
    ]
    got = signals.cluster(spark.createDataFrame(rows, SCHEMA), targets).collect()
    assert len(got) == len({r.id for r in got})
    return {r.id: r for r in got}


def test_groups(clustered):
    groups = {}
    for r in clustered.values():
        if r.component is not None:
            groups.setdefault(r.component, set()).add(r.id)
    assert {1, 2} in groups.values() and {3, 4} in groups.values() and {20, 21} in groups.values() and {60, 61, 62} in groups.values()
    # the links of one case stop before the second target
    assert clustered[30].component != clustered[31].component and clustered[32].component in (clustered[30].component, clustered[31].component)
    assert clustered[50].component == 50


def test_reasons(clustered):
    want = {1: "case-family", 3: "site", 20: "name", 30: "target", 60: "entity", 62: "entity", 40: "unclustered:container-record", 80: "unclustered:no-usable-text", 81: "unclustered:foreign-source"}
    want |= {k: "unclustered:no-signal" for k in (10, 13, 41, 51, 63, 64, 90, 91)}
    assert {k: clustered[k].reason for k in want} == want
    # below the least length, the headline is no signal either
    assert clustered[22].reason == "unclustered:no-signal" and not {70, 71, 72} & clustered.keys()
    assert clustered[1].project_key == "case:phoenix:z-12-a-1" and clustered[30].project_key == "target:heart-hotel"


def test_facts_are_about_the_project(spark):
    text = "Heart Hotel adds 752 rooms. The market has 150,234 hotel rooms. Acme got US$8-billion and $200. Kulik River built a 1.5 million square feet hall, 29-storey."
    rows = facts.fact_rows(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), "id", "text")
    got = {(r.kind, r.display, r.value) for r in rows.collect()}
    assert got == {("rooms", "752 rooms", 752.0), ("money", "US$8-billion", 8e9), ("sqft", "1.5 million square feet", 1.5e6), ("floors", "29-storey", 29.0)}
    terms = rows.withColumn("terms", facts.attribution_terms(F.lit("Heart Hotel"), F.lit("Kulik River, LLC")))
    assert {r.kind for r in facts.entry_facts(terms, "id", "terms").collect()} == {"rooms", "sqft", "floors"}
    bad = rows.withColumn("text", F.lit("other")).limit(1)
    assert facts.invented(bad, "text").count() == 1


def test_attribution_terms(spark):
    row = spark.range(1).select(facts.attribution_terms(F.lit("Kulik River / Phase 2|The Mill"), F.lit("Acme Lodge, LLC"), F.lit(None)).alias("t"), facts.attribution_terms(F.lit(None)).alias("none")).first()
    assert set(row.t) == {"kulik river", "phase 2", "the mill", "acme lodge", "kulik", "lodge"} and row.none == []


def test_sentences_keep_their_digits(spark):
    # a function of two arguments would be given the place too
    assert spark.range(1).select(facts.sentences(F.lit("0 is here. 1 is there 1\n 2 more 2 "))).first()[0] == ["0 is here.", "1 is there 1", "2 more 2"]


def test_exclusions_cannot_be_bypassed(spark):
    row = spark.range(1).select(
        *[taxonomy.decision(F.lit(r), F.lit(False), F.lit("legistar"), F.lit(True), F.lit(True), F.lit("firm"), F.lit(False), F.lit(False)).alias(n) for n, r in (("a", "excluded"), ("b", "no-match"))]
    ).first()
    assert not row.a.admitted and row.a.reason == "excluded" and row.b.admitted and row.b.reason == "bypass"


def test_scorer_faults_are_nulls(spark):
    def scorer(batch):
        if (batch["x"] < 0).any():
            raise ValueError("negative")
        return batch["x"]

    df = spark.createDataFrame([(5,), (-1,), (500,)], "x long").coalesce(1)
    assert sorted((r.x, r.score) for r in scoring.scored(df, scorer, ["x"]).collect()) == [(-1, None), (5, 5), (500, None)]


def test_ledger_keeps_what_it_has(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("b", 1, 6)], "unit string, day int, n int")
    ledger = writes.append_ledger(None, rows, ["unit", "day"])
    again = writes.append_ledger(ledger, spark.createDataFrame([("a", 1, 9), ("a", 2, 7)], rows.schema), ["unit", "day"])
    assert sorted(map(tuple, again.collect())) == [("a", 1, 5), ("a", 2, 7), ("b", 1, 6)]


def alike(a, b):
    if min(len(a), len(b)) < 10 or a.split(" ")[0] != b.split(" ")[0]:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return 1 - row[-1] / max(len(a), len(b)) >= 0.9


def clustered_by_hand(own, texts):
    """(component, reason, key) of every record: ``own`` signals (id, market, reason, key, place, target), ``texts`` of press (id, market, folded text)."""
    known = {(m, k.split(":", 2)[2]) for _, m, r, k, _, _ in own if r == "entity" and len(k.split(":", 2)[2]) >= 10}
    have = {i for i, _, r, *_ in own if r == "entity"}
    target = {i: t for i, *_, t in own}
    rows = list(own)
    for i, m, text in texts:
        hits = [e for n, e in known if n == m and f" {e} " in f" {text} "]
        if i not in have and len(hits) == 1:
            rows.append((i, m, "entity", f"entity:{m}:{hits[0]}", 1 << 30, target.get(i)))
    n = Counter(k for _, k in {(i, k) for i, _, _, k, _, _ in rows})
    rows = [x for x in rows if not (x[3].startswith("site:") and x[3].split(":", 2)[2].startswith("addr:") and n[x[3]] > 3) and not (x[2] == "name" and n[x[3]] < 2)]
    names = sorted({(m, k) for _, m, r, k, _, _ in rows if r == "entity"})
    pairs = [(a, b) for k, (m, a) in enumerate(names) for o, b in names[k + 1 :] if m == o and alike(a.split(":", 2)[2], b.split(":", 2)[2])]
    component = replayed([(i, k, t, p) for i, _, _, k, p, t in rows], pairs)
    strength = {r: k for k, r in enumerate(signals.REASONS)}
    best, keys = {}, {}
    for i, _, r, k, _, _ in rows:
        best[i] = min(best.get(i, (9, "")), (strength[r], k))
    for i, b in best.items():
        keys[component[i]] = min(keys.get(component[i], b), b)
    return {i: (component[i], signals.REASONS[b[0]], keys[component[i]][1]) for i, b in best.items()}, len(pairs)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_watched_clusters_by_hand(spark):
    from sparrowgrid.operators.dictionary import folded

    rows = clusters.dockets(spark, SF)
    live = rows.where("coalesce(status, '') <> 'dismissed' and coalesce(cluster_reason, '') <> 'detached'")
    own = [(r.id, r.market, r.reason, r.key, r.place, r.target) for r in signals.emit(live, clusters.WATCHED).collect()]
    press = live.where((F.col("stream") == "intelligence") & ~signals.is_container()).select("id", signals.market_key(), folded(F.concat_ws("\n", "title", "body")))
    want, pairs = clustered_by_hand(own, [tuple(r) for r in press.collect()])
    got = {r.id: r for r in clusters.watched_clusters(spark, SF).collect()}
    assert {i: (r.component, r.reason, r.project_key) for i, r in got.items() if r.component is not None} == want
    assert set(got) == {r.id for r in live.collect()} and {r for _, r, _ in want.values()} == set(signals.REASONS) and pairs > 0
    # the guard has work: fewer links than without targets
    assert replayed([(i, k, None, p) for i, _, _, k, p, _ in own]) != replayed([(i, k, t, p) for i, _, _, k, p, t in own])
