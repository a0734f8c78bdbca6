"""What round 4 found: plans that fill the driver, pairs that fill the disk."""

import os
import random
from collections import Counter

import pytest

from sparrowgrid.operators import graph, projects, resolve, scopes, signals, tables
from sparrowgrid.plans import registry

SF = "/root/testdata/sf0.001"


def longest_plan(spark, monkeypatch, name):
    """Steps of the longest plan that a query gives the driver to run, its result's among them."""
    steps = []

    def counted(df, name, written=tables.written):
        steps.append(df._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        return written(df, name)

    for module in (graph, projects, resolve, signals):
        monkeypatch.setattr(module, "written", counted)
    out = registry.QUERIES[name](spark, SF)
    steps.append(out._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    return max(steps)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_arrivals_read_texts_once(spark, monkeypatch):
    assert longest_plan(spark, monkeypatch, "arrived_clusters") < 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_press_is_read_once(spark, monkeypatch):
    assert longest_plan(spark, monkeypatch, "watched_clusters") < 100


def shuffled(spark):
    """Bytes that all shuffles so far have written."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def test_a_pair_of_neighbours_travels_once(spark):
    rng = random.Random(4)
    rows = [(a, b) for b in range(300) for a in rng.sample(range(200), 60)]
    df = spark.createDataFrame(rows, "a long, b long").coalesce(1)
    before = shuffled(spark)
    found = scopes.related(df, "a", "b").selectExpr("sum(shared)").first()[0]
    assert found == 300 * 60 * 59 and shuffled(spark) - before < 0.7 * found


@pytest.mark.parametrize("kind", ["long", "int", "string"])
@pytest.mark.parametrize("most", [2, 256])
def test_neighbours_by_hand(spark, monkeypatch, kind, most):
    monkeypatch.setattr(scopes, "LIST", most)
    values = {
        "long": [-(1 << 63), -5, 0, 7, 32767, 32775, 40000, 1 << 31, (1 << 31) + 8, (1 << 63) - 1, None],
        "int": [-(1 << 31), 0, 5, 40000, (1 << 31) - 1],
        "string": ["", "a", "é", "b", None],
    }
    rng = random.Random(1)
    rows = [(rng.choice(values[kind]), rng.choice([1, 2, 3, None])) for _ in range(120)]
    n, want = Counter(r for r in rows if None not in r), {}
    for (a, b), _ in n.items():
        for (x, y), w in n.items():
            if b == y and a != x:
                shared, links = want.get((a, x), (0, 0))
                want[a, x] = shared + 1, links + w
    got = [tuple(r) for r in scopes.related(spark.createDataFrame(rows, f"i {kind}, x int"), "i", "x").collect()]
    assert sorted(got) == sorted((*k, *v) for k, v in want.items())
