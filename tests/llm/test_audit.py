"""The filter audit against applying the filters one after another, in every order."""

import itertools
import random
import re

import pytest

from sparrowgrid.llm import audit
from sparrowgrid.llm.common import settle

SCHEMA = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(autouse=True)
def _settled(spark):
    settle(spark)


def failing(rows):
    """The letters each row fails."""
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = []
    for i, text, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": re.search(r"[#$%&*|]", t) is not None,
            "E": i is not None and t in first and first[t] < i,
        }
        out.append({k for k, v in tests.items() if v})
    return out


def brute(rows, labels):
    marks = {}
    for i, q, x in labels:
        if i is not None:
            marks.setdefault(i, [0, 0])
            marks[i][0] |= q == 1
            marks[i][1] |= x == 1
    fails, out = failing(rows), {}
    for part in {r[2] or "" for r in rows}:
        mine = [(f, *marks.get(r[0], (0, 0))) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            here = mine
            for k, x in enumerate(order):
                gone = [m for m in here if x in m[0]]
                stay = [m for m in here if x not in m[0]]
                total = sum(x in m[0] for m in mine)
                shapley[x] += len(gone)
                out[part, order, k + 1] = [len(stay), len(gone), total - len(gone), sum(m[0] == {x} for m in mine), sum(m[1] for m in gone), sum(m[2] for m in gone)]
                here = stay
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def texts(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = [rng.choice(["alpha", "Beta", "GAMMA", f"w{rng.randrange(3000)}", f"w{rng.randrange(3000)}"]) for _ in range(rng.choice([0, 3, 199, 200, 260]))]
        w += rng.choice([[], [], ["$5"], ["|"]])
        rows.append((i, rng.choice([" ", "\n", "\x0b", "  ", "  "]).join(w), rng.choice(["en", "de", None, ""])))
    rows += [(n + k, rows[rng.randrange(n)][1], "en") for k in range(n // 2)]
    # nulls in every column, a long text, repeated rows, a repeated id with another text
    rows += [(None, None, None), (None, "x y", "en"), (5000, None, "en"), (5001, "", "fr"), (5002, "lang " * 50_000, "en")] + rows[:2] * 2 + [(rows[0][0], "other", "en")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = texts(seed, 60)
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for r in rows if rng.random() < 0.6] + [(None, 1, 1), (99_999, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "m", None) for r in rows], SCHEMA + ", mask int, part string, quality int").repartition(3)
    got = audit.interactions(docs, spark.createDataFrame([(*r, "x") for r in labels], LABELS + ", text string")).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == brute(rows, labels) and len(got) == 600 * len({r[2] or "" for r in rows})


def test_no_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a", "en")], SCHEMA)
    labels = spark.createDataFrame([], LABELS)
    assert audit.interactions(docs.limit(0), labels).count() == 0
    assert {tuple(r)[:3]: tuple(r)[3:] for r in audit.interactions(docs, labels).collect()} == brute([(1, "a", "en")], [])
