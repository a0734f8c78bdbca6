"""Operators and queries that answer for all rows, against brute force."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from sparrowgrid.operators import dictionary, resolve, scopes
from sparrowgrid.plans import registry

SF = "/root/testdata/sf0.001"


def test_history_is_for_every_project(spark):
    edges = [(1, "a"), (1, "a"), (2, "a"), (3, "a"), (2, "b"), (4, "c"), (5, "c"), (107, "c"), (None, "c"), (6, None)]
    known = {e for e in edges if None not in e}
    want = {(p, s): (len(rest := {q for q, t in known if t == s and q != p}), min(rest)) for p, s in known if any(t == s and q != p for q, t in known)}
    got = scopes.history(spark.createDataFrame(edges, "p long, s string"), "p", "s").collect()
    assert {(r.p, r.s): (r.others, r.first_other) for r in got} == want and len(got) == len(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_party_history_leaves_no_project_out(spark):
    items = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_suppkey").distinct()
    # each of the ten suppliers has several projects, so every pair has a history
    assert registry.QUERIES["party_history"](spark, SF).count() == items.count()
    assert registry.QUERIES["players_summary"](spark, SF).first().attached == items.select("l_suppkey").distinct().count()


def replayed(rows, alike=()):
    """Components by replaying links one by one: rows are (record, key, target, place), ``alike`` pairs of keys."""
    rows = [(*r, 0)[:4] for r in rows]
    root, targets = {}, {}
    for r, _, t, _ in rows:
        root[r] = r
        if t is not None:
            targets[r] = min(t, targets.get(r, t))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(x, y):
        a, b = sorted((find(x), find(y)))
        if a != b and not (a in targets and b in targets and targets[a] != targets[b]):
            root[b] = a
            if b in targets:
                targets[a] = targets[b]

    # keys as they are first seen
    of = {}
    for r, k, _, _ in sorted((x for x in rows if x[1] is not None), key=lambda x: (x[0], x[3], x[1])):
        of.setdefault(k, []).append(r)
    for rs in of.values():
        for r in rs[1:]:
            join(rs[0], r)
    seen = {k: n for n, k in enumerate(of)}
    for a, b in sorted(sorted((seen[a], seen[b])) for a, b in alike if a in seen and b in seen):
        join(list(of.values())[a][0], list(of.values())[b][0])
    return {r: find(r) for r in root}


@pytest.mark.parametrize("seed", range(6))
def test_guard_is_the_replay(spark, seed):
    rng = random.Random(seed)
    target = {r: rng.choice("XYZ") for r in range(120) if rng.random() < (0.5, 0.1, 0.3, 0.9, 0.2, 0.4)[seed]}
    rows = [(r, f"k{rng.randrange((40, 60, 90, 30, 80, 120)[seed])}", target.get(r), p) for r in range(120) for p in range(rng.choice([1, 1, 2, 3]))] + [(500, None, None, 0), (501, None, "X", 0)]
    alike = sorted({tuple(sorted(rng.sample([f"k{i}" for i in range(120)], 2))) for _ in range((0, 10, 20, 20, 40, 40)[seed])})
    rng.shuffle(rows)
    signals = spark.createDataFrame(rows, "r long, k string, t string, p int")
    got = resolve.guarded_components(signals, "r", "k", "t", "p", spark.createDataFrame(alike, "a string, b string") if alike else None).collect()
    assert {r.r: r.component for r in got} == replayed(rows, alike) and len(got) == 122


@pytest.mark.parametrize("seed", range(3))
def test_fuzzy_pairs_are_all_pairs(spark, seed):
    rng, names = random.Random(seed), []
    for n in range(150):
        base = list(rng.choice(["acme river capital", "acme rivers capital partners llc", "acme hollow", "acme " + "long " * 9]))
        for _ in range(rng.choice([0, 1, 2, 4])):
            at = rng.randrange(len(base))
            base[at : at + rng.randrange(2)] = rng.choice(["", "a", "x", "zz"])
        names.append((n, "".join(base), rng.choice("MN")))

    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    near = lambda x, y: x[2] == y[2] and min(len(x[1]), len(y[1])) >= 10 and 1 - apart(x[1], y[1]) / max(len(x[1]), len(y[1])) >= 0.9
    want = {(x[0], y[0]) for k, x in enumerate(names) for y in names[k + 1 :] if near(x, y)}
    got = resolve.fuzzy_pairs(spark.createDataFrame(names, "id long, name string, m string"), "id", "name", F.col("m")).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 100


@pytest.mark.parametrize("seed", range(2))
def test_term_hits_are_the_scan(spark, seed):
    rng = random.Random(seed)
    words = ["kulik", "river", "capital", "acme", "of", "the", "st", "road", "a1"]
    texts = [(i, rng.choice([" ", ", ", "\n", "-"]).join(rng.choice(words) for _ in range(rng.randrange(12))), rng.choice(["M", "N", None])) for i in range(200)] + [(900, None, "M"), (901, "KULIK   River!", "M")]
    terms = [(" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3]))), rng.choice(["M", "N", None])) for _ in range(25)] + [("", "M"), ("--", "M"), (None, "M"), ("Kulik River", "M"), ("nowhere found", "M")]
    fold = lambda s: re.sub("[^a-z0-9]+", " ", (s or "").lower()).strip()

    def named(text, term):
        """Not only streets of that name."""
        at, found = f" {text} ", []
        while (k := at.find(f" {term} ")) >= 0:
            at = at[k + 1 + len(term) :]
            found.append(re.match(rf" +(?:{dictionary.ROAD})\b", at))
        return not all(found)

    frames = spark.createDataFrame(texts, "id long, said string, m string"), spark.createDataFrame(terms, "t string, m string")
    for streets in (True, False):
        want = {(i, t) for i, s, m in texts for t, n in terms if m == n and fold(t) and f" {fold(t)} " in f" {fold(s)} " and (streets or named(fold(s), fold(t)))}
        got = dictionary.term_hits(*frames, "id", "said", "t", "m", streets).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want) > 20


def folded(rows, least, shared):
    out, kept = {}, []
    for i, b, w in sorted(((i, b, set(w)) for i, b, w in rows), key=lambda x: (-len(x[2]), x[0])):
        same = next((k for k, c, x in kept if c == b and (x == w or len(x & w) >= shared and len(x & w) >= least * min(len(x), len(w)))), None)
        if same is None:
            kept.append((i, b, w))
        out[i] = i if same is None else same
    return out


@pytest.mark.parametrize("least, shared", [(0.6, 2), (0.6, 4), (0.34, 1), (1.0, 1)])
def test_near_duplicates_are_the_fold(spark, least, shared):
    rng = random.Random(int(least * 100) + shared)
    rows = [(i, rng.choice([1, 2, None]), [rng.choice("abcdefghijklm") for _ in range(rng.randrange(8))]) for i in range(200)]
    got = resolve.near_duplicate_records(spark.createDataFrame(rows, "i long, b int, w array<string>"), "i", ["b"], "w", least, shared).collect()
    assert {r.i: r.kept_id for r in got} == folded(rows, least, shared) and len(got) == 200


def test_no_group_meets_in_a_python_task(spark):
    """Neither operator hands a component or a block to one task."""
    signals = spark.createDataFrame([(1, "a", "X"), (2, "a", "Y")], "r long, k string, t string")
    records = spark.createDataFrame([(1, 1, ["a", "b"]), (2, 1, ["a", "b"])], "i long, b int, w array<string>")
    for df in (resolve.guarded_components(signals, "r", "k", "t"), resolve.near_duplicate_records(records, "i", ["b"], "w", shared=1)):
        assert "Pandas" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_clusters_keep_every_document(spark, tmp_path):
    # one line on 300 documents, lines of pairs, and texts without any line
    texts = {i: f"one opening line of all\nbody {i}" for i in range(300)} | {i: f"begin {i // 2} of a pair\n  end {i}" for i in range(300, 320)} | {400: None, 401: "", 402: " \n "}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(i, x.strip(" ") or None, str(i % 3) if i % 50 == 0 else None, p) for i, t in texts.items() for p, x in enumerate((t or "").split("\n"))]
    for name, given in {"cluster_components": [(i, k, None) for i, k, _, _ in rows], "cluster_guarded": rows}.items():
        got = registry.QUERIES[name](spark, str(tmp_path)).collect()
        assert {r.doc_id: r.component for r in got} == replayed(given)
        assert len(got) == len(texts)


def canonical(names, least=0.9):
    """Every name with its canonical one, by comparing all names of a first word in order."""

    def alike(a, b):
        if min(len(a), len(b)) < 10:
            return a == b
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return 1 - row[-1] / max(len(a), len(b)) >= least

    found, canon = {}, []
    for n in sorted(names):
        match = next((c for c in canon if c.split(" ")[0] == n.split(" ")[0] and alike(c, n)), None)
        if match is None:
            canon.append(n)
            found[n] = n
        elif len(n) < len(match):
            canon[canon.index(match)] = n
            found = {k: n if v == match else v for k, v in found.items()} | {n: n}
        else:
            found[n] = match
    return found


@pytest.mark.parametrize("seed", range(3))
def test_names_are_the_fold(spark, seed):
    rng, names = random.Random(seed), {"short", "shorter x", ""}
    for _ in range(160):
        base = list(rng.choice(["acme river capital partners", "acme harbor holdings west", "north valley development", "north valley developments east"]))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            at = rng.randrange(6, len(base))
            base[at : at + rng.randrange(2)] = rng.choice(["", "a", "x", "s"])
        names.add("".join(base))
    got = resolve.consolidate(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert {r.name: r.canonical for r in got} == canonical(names - {""}) and len(got) == len(names) - 1
