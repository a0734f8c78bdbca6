"""Operator 6's model against plain sums: equal contexts, out-of-range values, repeated rows, other words."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from sparrowgrid.llm import neural_lm

DOCS = "doc_id long, text string"
COUNTS = np.array([900, 500, 300, 200, 90, 80, 70, 60, 50, 9, 8, 7])


def model_of(dim: int, scale: float = 1.0) -> neural_lm.Model:
    model = neural_lm.Model(COUNTS, 40, neural_lm.Settings(classes=4, dim=dim, noise=4, batch=64))
    for name in ("c", "q", "r"):
        model.p[name][:, :dim] *= scale
    return model


def tokens(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    words, begins = rng.integers(0, len(COUNTS) + 1, n).astype(np.int32), np.zeros(n, bool)
    begins[::37] = True
    return words, begins


@pytest.mark.parametrize("scale", [1.0, 10.0, 60.0])
def test_log_probs_are_the_softmaxes(scale):
    model, (words, begins) = model_of(4, scale), tokens(500)
    p = {name: x.astype(np.float64) for name, x in model.p.items()}
    a, b = model.contexts(words, begins)

    def log_softmax(h, table):
        x = table[:, :4] @ h + table[:, 4]
        return x - x.max() - np.log(np.exp(x - x.max()).sum())

    expected = []
    for w, i, j in zip(words, a, b, strict=True):
        h = p["a"][:, :4] @ p["r"][i][:4] + p["b"][:, :4] @ p["r"][j][:4]
        k = model.class_of[w]
        inside = 0.0 if model.single[k] else log_softmax(h, p["q"][model.edges[k] : model.edges[k + 1]])[w - model.edges[k]]
        expected.append(log_softmax(h, p["c"])[k] + inside)
    assert np.allclose(model.log_probs(words, begins), expected, rtol=1e-4, atol=1e-4)


def test_equal_contexts_are_summed_over_once(monkeypatch):
    model, (words, begins) = model_of(4), tokens(20_000)
    cells, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda x, *rest, **named: (cells.append(np.size(x)), exp(x, *rest, **named))[1])
    model.log_probs(words, begins)
    contexts = (len(COUNTS) + 2) ** 2
    assert sum(cells) <= 2 * contexts * (len(model.p["c"]) + len(COUNTS))


@pytest.mark.parametrize("dim", [3, 4])
def test_a_step_sums_the_gradients_of_equal_rows(dim):
    rng = np.random.default_rng(3)
    for name, scale in (("c", 32), ("q", 1), ("r", 1)):
        model = model_of(dim)
        table, squares, rate = model.p[name].astype(np.float64), model.squares[name].astype(np.float64), model.s.rate
        wide = dim if name == "r" else dim + 1
        rows = np.append(rng.integers(0, len(table) - 2, 40), len(table) - 1).astype(np.int32)
        grads = rng.normal(size=(len(rows), wide)).astype(np.float32)
        touched = {n: np.zeros(len(x), np.int64) for n, x in model.p.items()}
        model._step(name, rows, grads, scale, touched)
        for row in np.unique(rows):
            at = rows == row
            g = grads[at].astype(np.float64).sum(axis=0) / (scale if scale > 1 else np.sqrt(at.sum()))
            squares[row] += (g * g).sum() / wide
            table[row, :wide] -= rate * g / np.sqrt(squares[row])
        assert np.allclose(model.p[name], table, atol=1e-5) and np.allclose(model.squares[name], squares, rtol=1e-4)
        assert (touched[name] == np.isin(np.arange(len(table)), rows)).all()


def test_rows_beyond_sixteen_bits_are_sorted():
    rows = np.random.default_rng(1).choice(np.array([0, 1, 2, 65_535, 65_536, 65_537, 131_072], np.int32), 200)
    assert (neural_lm._sorting(rows) == np.argsort(rows, kind="stable")).all()


def test_other_words_are_counted_by_text():
    texts = ["b A x x", None, "x y y ü üü x", "a"]
    ranks, bounds, found = neural_lm._stretch(texts, {b"a": 0, b"b": 1, b"": 2})
    assert ranks.tolist() == [1, 0, -1, -1, 2, 2, -1, -1, -1, -1, -1, -1, 2, 0, 2] and bounds.tolist() == [0, 5, 6, 13, 15]
    names, times = neural_lm._rare(ranks, bounds, found)
    got = [dict(zip(w, n, strict=True)) for w, n in zip(names.to_pylist(), times.to_pylist(), strict=True)]
    assert got == [{"x": 2}, {}, {"x": 2, "y": 2, "ü": 1, "üü": 1}, {}]


def test_nothing_to_learn_from(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    got = neural_lm.score(spark.createDataFrame([(i, "some words" if i % 2 else None) for i in held], DOCS)).collect()
    assert len(got) == len(held) > 5
    for r in got:
        assert r.held_out and r.n_known == r.train_tokens == 0 and r.n_tokens == (3 if r.doc_id % 2 else 1)
        assert abs(r.base_score) < 1e-9 and abs(r.score) < 1e-6
