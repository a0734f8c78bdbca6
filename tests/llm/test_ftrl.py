"""The quality classifier: features and updates against plain Python, what is learned from, and accuracy on held-out documents."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparrowgrid.llm import ftrl
from sparrowgrid.llm.common import settle

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


@pytest.fixture(autouse=True)
def _settled(spark):
    settle(spark)


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def brute_grams(text, s):
    """{(family, n-gram): value} of a text, with whole words and shapes instead of hashes."""
    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode())]
    shapes = []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode()):
        kinds = re.sub(rb"[a-z\x80-\xff]", b"a", re.sub(rb"[A-Z]", b"A", re.sub(rb"[0-9]", b"0", w)))
        shapes.append(re.sub(rb"(.)\1+", rb"\1", kinds, flags=re.S))
    shapes = [(x, k > 0 and words[k] == words[k - 1]) for k, x in enumerate(shapes)]
    out = {}
    for k, (kind, n) in enumerate(s.families):
        of = words if kind == "word" else shapes
        grams = Counter(tuple(of[i : i + n]) for i in range(len(of) - n + 1))
        out |= {(k, g): math.sqrt(c / grams.total()) for g, c in grams.items()}
    return out


@pytest.mark.parametrize("segment", [1 << 20, 16, 1])
def test_features(monkeypatch, segment):
    monkeypatch.setattr(ftrl, "SEGMENT", segment)
    rng = random.Random(5)
    words = ["a", "A", "ab", "The", "éa", "été", "12", "x1", "###", "and&&&", "and&", "日本", "-", "UPPER!!", "\xa0", "w" * 50]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\n", "\t", " \x0b "]) for _ in range(rng.choice([0, 1, 2, 40]))) for _ in range(60)]
    texts += ["", None, "ends", "starts", "same same", " "]
    s = ftrl.Settings(bits=24)
    of, columns, values = ftrl.features(*ftrl._texts(pa.array(texts)), s)
    names = {}
    for i, text in enumerate(texts):
        mine = of == i
        want = brute_grams(text or "", s)
        got = dict(zip(columns[mine].tolist(), values[mine].tolist(), strict=True))
        assert got.pop(s.columns - 1) == 1 and len(got) == mine.sum() - 1 == len(want)
        for k in range(len(s.families)):
            assert sorted(v for c, v in got.items() if c >> s.bits == k) == pytest.approx(sorted(v for (f, _), v in want.items() if f == k))
        for k in range(len(s.families)):  # a family's only n-gram tells which column it has
            if len(only := [g for f, g in want if f == k]) == 1:
                names.setdefault((k, only[0]), set()).update(c for c in got if c >> s.bits == k)
    assert len(names) > 15 and all(len(x) == 1 for x in names.values())


def test_updates_are_the_published_ones():
    s, rng = ftrl.Settings(bits=4), random.Random(1)
    leader, z, n = ftrl.Leader(s), Counter(), Counter()
    weight = lambda c: 0 if abs(z[c]) <= s.l1 else -(z[c] - math.copysign(s.l1, z[c])) / ((s.beta + math.sqrt(n[c])) / s.alpha + s.l2)
    for _ in range(200):
        columns = rng.sample(range(40), 6)
        values, label = [rng.random() for _ in columns], rng.randrange(2)
        leader.learn(np.array(columns), np.array(values), label)
        w = {c: weight(c) for c in columns}
        p = 1 / (1 + math.exp(-sum(w[c] * v for c, v in zip(columns, values, strict=True))))
        for c, v in zip(columns, values, strict=True):
            g = (p - label) * v
            z[c] += g - (math.sqrt(n[c] + g * g) - math.sqrt(n[c])) / s.alpha * w[c]
            n[c] += g * g
    assert leader.weights()[:40] == pytest.approx([weight(c) for c in range(40)])


def corpus(spark, seed=3, n=300):
    rng = random.Random(seed)
    good = lambda: " ".join(rng.choice(["river", "hill", "of", "the", f"w{rng.randrange(500)}"]) for _ in range(30)) + "."
    bad = lambda: " ".join(rng.choice(["BUY!!", "now$$", f"W{rng.randrange(500)}!!"]) for _ in range(30))
    rows = [(i, good() if i % 3 else bad()) for i in range(n)]
    return rows, [(i, int(i % 3 > 0), 0) for i, _ in rows]


def scores(df):
    return {r.doc_id: r.score for r in df.collect()}


def test_what_is_learned_from(spark):
    rows, labels = corpus(spark)
    docs = spark.createDataFrame([(*r, 0.5, 7, "x") for r in rows], SCHEMA + ", score double, label int, turn string")
    frame = lambda x: spark.createDataFrame(x, "doc_id long, quality int, toxic int")
    out = ftrl.classify(docs.repartition(7), frame(labels))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    first = scores(out)
    assert all(r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.7) for r in out.collect())
    # neither held-out labels, contradictory or null ones, nor the partitioning change a score
    turned = [(i, 1 - q if held(i) else q, t) for i, q, t in labels] + [(None, 1, 0), (9999, None, 0), (0, None, 1)]
    assert scores(ftrl.classify(docs.coalesce(1), frame(turned))) == first
    one = next(i for i, q, _ in labels if q and not held(i))
    fewer = [x for x in labels if x[0] != one]
    assert scores(ftrl.classify(docs, frame(fewer))) != first
    assert scores(ftrl.classify(docs, frame(labels + [(one, 0, 0)]))) == scores(ftrl.classify(docs, frame(fewer)))
    assert sum((first[i] >= 0.7) == (i % 3 > 0) for i, _ in rows) >= 0.98 * len(rows)


def test_sample_is_bounded(spark):
    rows, labels = corpus(spark)
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    s = ftrl.Settings(sample=50)
    a, b = (sorted(r.id for r in ftrl.sampled(d, known, s).collect()) for d in (docs, docs.repartition(5)))
    assert a == b and len(a) == 50


def test_odd_rows(spark):
    rows, labels = corpus(spark, n=60)
    more = [(None, None), (None, "a b"), (1000, None), (1001, ""), (1002, " \n"), (1003, "long words " * 200_000), rows[0], rows[0]]
    docs, known = spark.createDataFrame(rows + more, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = ftrl.classify(docs, known).collect()
    assert len(got) == 68 and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    of = {}
    for r in got:
        of.setdefault(r.doc_id, set()).add(r.score)
    assert of[1000] == of[1001] == of[1002] and all(len(x) == 1 for i, x in of.items() if i is not None)
    assert ftrl.classify(docs.limit(0), known).count() == 0
    assert {r.score for r in ftrl.classify(docs, known.limit(0)).collect()} == {0.5}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_held_out_accuracy(spark):
    from sparrowgrid.llm import queries as q

    got = {r.doc_id: r for r in q.op11_quality_classifier(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == docs.count()
    known = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if held(r.doc_id)]
    assert all(x.held_out for x, _ in known) and len(known) > 50
    # against 0.86 for calling all of them good
    assert sum(x.predicted == y for x, y in known) >= 0.97 * len(known)
    pairs = [(a.score, b.score) for a, y in known if y for b, x in known if not x]
    assert sum(a > b for a, b in pairs) >= 0.99 * len(pairs)
