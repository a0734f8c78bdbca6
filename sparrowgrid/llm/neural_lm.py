"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Word counts of all training texts give the noise distributions, the vocabulary
and its classes; a word's probability is its class's times its own inside the
class, both normalised by batched matrix products.  Words beyond the vocabulary
share one class, in which a word has its smoothed share of the counts.

Texts are cut and looked up once; training and scoring read the ranks of their
words.  A softmax's sum is taken once for all tokens of a slice that have the
same context.

Training is dealt to shards by a hash of the document, as many as the tokens
ask for and none that depends on how the input is partitioned.  In every round
each shard trains a copy of the model (numpy) on its next part, and Spark
averages the rows of the copies by how often they were updated; after the last
round every training token has been learned from once.
"""

from __future__ import annotations

from collections import Counter
from copy import deepcopy
from dataclasses import dataclass
from itertools import repeat
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowgrid.llm.common import bounded, release, written

END = ""  # no word is empty
#: Distinct words a counting task holds before it passes its counts on.
HELD = 500_000
#: Bytes of coded text, two a token, that are scored at a time.
SCORED_BYTES = 2 << 20


#: Noise words kept for each class, and cells of a softmax held at a time (they stay in a core's cache).
POOL, CELLS = 1024, 64_000


@dataclass(frozen=True)
class Settings:
    #: The vocabulary: the most frequent words, whose counts every worker has; others' counts are joined.
    words: int = 65_535
    classes: int = 256
    dim: int = 16
    #: Noise samples for the class (shared by a batch) and for the word in its class (each token's own).
    noise: int = 16
    inner: int = 2
    batch: int = 1024
    rate: float = 0.05
    rounds: int = 3
    #: Training tokens of a shard.
    shard: int = 4_000_000
    seed: int = 7


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased runs of bytes other than ASCII white space."""
    return text.encode().lower().split() if text else []


def is_training(id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) != 1


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) over all rows' ``text``, with one end for each row."""

    def run(batches):
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"]
            )
            held.clear()
            return out

        for part in bounded(batches, "text"):
            for text in part.column(0).to_pylist():
                held.update(words_of(text))
                held[b""] += 1
            if len(held) > HELD:
                yield flush()
        if held:
            yield flush()

    return rows.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Model:
    """score(w | a, b) in two normalised steps: the word's class, then the word in its class.

    Both are softmaxes of (A r_a + B r_b) . q + bias, with q the class's or the
    word's vector.  Words are numbered by falling counts; classes are ranges of
    them with equal sums of square roots of counts; the last class holds all
    other words and is not split further here.
    """

    def __init__(self, counts: np.ndarray, other: float, s: Settings):
        """``counts`` of the words, most frequent first, and of all other words together."""
        n, self.s = len(counts), s
        rng = np.random.default_rng(s.seed)
        counts = counts.astype(np.float64) + 0.5
        roots = np.cumsum(np.sqrt(counts))
        k = min(s.classes, n)
        ends = np.searchsorted(roots, roots[-1] * np.arange(1, k) / k) + 1 if n else np.zeros(0, np.int64)
        self.edges = np.unique(np.concatenate([[0], ends, [n]])).astype(np.int64)
        k = len(self.edges) - 1
        self.class_of = np.append(np.repeat(np.arange(k), np.diff(self.edges)), k).astype(np.int32)  # others: the last
        self.unknown, self.start = n, n + 1
        sums = np.add.reduceat(counts, self.edges[:-1]) if n else np.zeros(0)
        share = np.append(sums, other + 0.5)
        self.noise = share / share.sum()
        inner = counts / sums[self.class_of[:n]]
        #: Parameters by name; c and q end with a bias.
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.p = {
            "c": np.hstack([small(k + 1, s.dim), np.log(self.noise)[:, None].astype(np.float32)]),
            "q": np.hstack([small(n, s.dim), np.log(inner)[:, None].astype(np.float32)]),
            "r": small(n + 2, s.dim),
            "a": np.eye(s.dim, dtype=np.float32),
            "b": np.eye(s.dim, dtype=np.float32),
        }
        #: Adagrad's sums, one a row.
        self.squares = {name: np.full(len(x), 1e-6, np.float32) for name, x in self.p.items()}
        self.log_inner = np.log(inner * s.inner).astype(np.float32)
        self.log_noise = np.log(self.noise * s.noise).astype(np.float32)
        # noise words of each class, by their shares in it
        pool = rng.random((k, POOL)) * sums[:, None] + np.append(0, np.cumsum(sums))[:-1, None]
        cumulative = np.cumsum(counts)
        self.pool = np.clip(np.searchsorted(cumulative, pool), self.edges[:-1, None], self.edges[1:, None] - 1).astype(np.int32)
        self.single = np.append(np.diff(self.edges) == 1, True)

    def contexts(self, words: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two words before each token; ``begins`` marks the first token of a text."""
        a, b = np.empty_like(words), np.empty_like(words)
        a[1:], b[2:] = words[:-1], words[:-2]
        a[:1], b[:2] = self.start, self.start
        first = np.flatnonzero(begins)
        a[first] = b[first] = self.start
        second = first + 1
        b[second[second < len(b)]] = self.start
        return a, b

    def train(self, words: np.ndarray, begins: np.ndarray, rng: np.random.Generator, touched: dict[str, np.ndarray]) -> None:
        """One pass of noise-contrastive steps over a stretch of tokens; ``touched`` counts the rows' updates."""
        around = np.stack(self.contexts(words, begins), axis=1)
        s, p, d = self.s, self.p, self.s.dim
        cumulative = np.cumsum(self.noise)
        every, pool = self.class_of.take(words), self.pool.ravel()
        hidden = np.ones((s.batch, d + 1), np.float32)  # ends with the biases' one
        for i in range(0, len(words), s.batch):
            w, kinds, near = words[i : i + s.batch], every[i : i + s.batch], around[i : i + s.batch].ravel()
            m, h = len(w), hidden[: len(w)]
            drawn = np.minimum(np.searchsorted(cumulative, rng.random(s.noise)), len(cumulative) - 1)
            r, both = p["r"].take(near, axis=0).reshape(m, 2 * d), np.concatenate([p["a"], p["b"]], axis=1)
            h[:, :d] = r @ both.T
            # classes: noise is shared by the batch
            c, cn = p["c"].take(kinds, axis=0), p["c"].take(drawn, axis=0)
            g_real = -_wrong(self.log_noise.take(kinds) - np.einsum("ij,ij->i", h, c))
            g_fake = _wrong(h @ cn.T - self.log_noise.take(drawn))
            g_h = g_fake @ cn
            c *= g_real[:, None]
            g_h += c
            self._step("c", np.concatenate([kinds, drawn]), np.concatenate([g_real[:, None] * h, g_fake.T @ h]), m, touched)
            # words inside classes of two or more: noise of their own class
            some = np.flatnonzero(~self.single.take(kinds))
            if len(some):
                k = len(some)
                places = kinds.take(some)[:, None] * POOL + rng.integers(0, POOL, (k, s.inner))
                asked, by = np.concatenate([w.take(some), pool.take(places.ravel())]), np.concatenate([some, np.repeat(some, s.inner)])
                q, hs = p["q"].take(asked, axis=0), h.take(by, axis=0)
                x = np.einsum("ij,ij->i", hs, q) - self.log_inner.take(asked)
                x[:k] *= -1
                g = _wrong(x)
                g[:k] *= -1
                q *= g[:, None]
                hs *= g[:, None]
                back = g_h.take(some, axis=0)
                back += q[:k]
                for j in range(s.inner):
                    back += q[k + j :: s.inner]
                _put(g_h, some, back)
                self._step("q", asked, hs, 1, touched)
            g_h = np.ascontiguousarray(g_h[:, :d])
            self._step("r", near, (g_h @ both).reshape(2 * m, d), 1, touched)
            sides = g_h.T @ r / m
            for name, g in (("a", sides[:, :d]), ("b", sides[:, d:])):
                self.squares[name] += np.einsum("ij,ij->i", g, g) / d
                p[name] -= s.rate * g / np.sqrt(self.squares[name])[:, None]
                touched[name] += 1

    def _step(self, name: str, rows: np.ndarray, grads: np.ndarray, scale: int, touched: dict[str, np.ndarray]) -> None:
        """One Adagrad step on the named rows, gradients of equal rows summed."""
        order = _sorting(rows)
        ordered = rows.take(order)
        begins = _changes(ordered)
        first = np.flatnonzero(begins)
        at, wide = ordered.take(first), grads.shape[1]
        times = np.concatenate([first[1:], [len(rows)]]) - first
        g = grads.take(order.take(first), axis=0)
        several = np.flatnonzero(times > 1)
        if len(several):  # rows named once are their own sums
            again = np.repeat(times > 1, times)
            some = grads.take(order[again], axis=0)
            if wide % 2 == 0:  # pairs of floats are added at once
                some = some.view(np.complex64)
            _put(g, several, np.add.reduceat(some, np.flatnonzero(begins[again]), axis=0).view(np.float32))
        if scale > 1:
            g *= 1.0 / scale
        else:
            g /= np.sqrt(times.astype(np.float32))[:, None]
        squares = self.squares[name].take(at) + np.einsum("ij,ij->i", g, g) / wide
        self.squares[name][at] = squares
        g *= (self.s.rate / np.sqrt(squares))[:, None]
        _put(self.p[name], at, self.p[name].take(at, axis=0) - g)
        touched[name][at] += 1

    def rows(self, touched: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, weights, values) of the rows that were updated; values are of one width and end with Adagrad's sum."""
        weights = np.concatenate([touched[name] for name in self.p])
        values = np.zeros((len(weights), self.s.dim + 2), np.float32)
        base = 0
        for name, x in self.p.items():
            values[base : base + len(x), : x.shape[1]], values[base : base + len(x), -1] = x, self.squares[name]
            base += len(x)
        some = np.flatnonzero(weights)
        return some, weights[some], values[some]

    def put(self, numbers: np.ndarray, values: np.ndarray) -> None:
        """Set the numbered rows."""
        base = 0
        for name, x in self.p.items():
            here = (numbers >= base) & (numbers < base + len(x))
            at = numbers[here] - base
            x[at] = values[here, : x.shape[1]]
            self.squares[name][at] = values[here, -1]
            base += len(x)

    def log_probs(self, words: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of the tokens; of other words, that of their class."""
        before, before2 = self.contexts(words, begins)
        d, p = self.s.dim, self.p
        # a softmax's sum belongs to its context: equal contexts, and equal ones inside a class, are summed over once
        keys = before.astype(np.int64) * len(p["r"]) + before2
        order = np.argsort(keys)
        new = _changes(keys.take(order))
        context = np.cumsum(new, dtype=np.int32) - 1
        at = order[new]
        h = (p["r"] @ p["a"].T).take(before.take(at), axis=0)
        h += (p["r"] @ p["b"].T).take(before2.take(at), axis=0)
        sums = _log_sums(h, p["c"])
        kinds = self.class_of.take(words.take(order)).astype(np.uint16)
        by_kind = np.argsort(kinds, kind="stable")
        order, context = order.take(by_kind), context.take(by_kind)
        bounds = np.searchsorted(kinds.take(by_kind), np.arange(len(self.edges) + 1))
        found = np.empty(len(words))
        for k in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[k], bounds[k + 1]
            here = context[a:b]
            near = h.take(here, axis=0)
            found[a:b] = near @ p["c"][k, :d] + p["c"][k, d] - sums.take(here)
            if not self.single[k]:
                new = _changes(here)
                inside = _log_sums(near[new], p["q"][self.edges[k] : self.edges[k + 1]])
                chosen = p["q"].take(words.take(order[a:b]), axis=0)
                found[a:b] += np.einsum("ij,ij->i", near, chosen[:, :d]) + chosen[:, d] - inside.take(np.cumsum(new) - 1)
        out = np.empty(len(words))
        out[order] = found
        return out


def _wrong(x: np.ndarray) -> np.ndarray:
    """The logistic function."""
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-x))


def _changes(x: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before it."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _log_sums(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each row of ``h`` the log of the sum of exp(row . vector + bias) over the table's rows."""
    d = h.shape[1]
    vectors, weights = np.ascontiguousarray(table[:, :d].T), np.exp(table[:, d])
    sums = np.empty(len(h), np.float32)
    step = max(1, CELLS // len(table))
    held = np.empty((min(step, len(h)), len(table)), np.float32)
    with np.errstate(all="ignore"):
        for i in range(0, len(h), step):
            part = h[i : i + step]
            logits = np.matmul(part, vectors, out=held[: len(part)])
            np.matmul(np.exp(logits, out=logits), weights, out=sums[i : i + step])
    logs = np.log(np.maximum(sums, 1e-30), dtype=np.float64)
    bad = np.flatnonzero(~(np.isfinite(sums) & (sums > 1e-30)))  # out of a float's range: from the greatest down
    for i in range(0, len(bad), step):
        at = bad[i : i + step]
        logits = h[at].astype(np.float64) @ vectors + table[:, d]
        top = logits.max(axis=1)
        logs[at] = top + np.log(np.exp(logits - top[:, None]).sum(axis=1))
    return logs


def _put(table: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """table[at] = values, each row moved as one value."""
    whole = f"V{table.shape[1] * table.itemsize}"
    table.view(whole).reshape(-1).put(at, values.view(whole).reshape(-1))


def _sorting(rows: np.ndarray) -> np.ndarray:
    """The stable order of row numbers below 2^24, by radix passes."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    if len(rows) and rows.max() > 0xFFFF:
        order = order.take(np.argsort((rows >> 16).astype(np.uint8).take(order), kind="stable"))
    return order


def _stretch(texts: list[str | None], index: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(ranks of all tokens, -1 for words not in the index; where each text begins, and the last ends; the tokens)."""
    tokens, bounds = [], [0]
    for text in texts:
        tokens += words_of(text)
        tokens.append(b"")
        bounds.append(len(tokens))
    return np.fromiter(map(index.get, tokens, repeat(-1)), np.int32, len(tokens)), np.array(bounds), tokens


def _rare(ranks: np.ndarray, bounds: np.ndarray, tokens: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """Each text's words that have no rank, and how often it has them."""
    lost, seen = np.flatnonzero(ranks < 0), {}
    numbers = np.fromiter((seen.setdefault(tokens[i], len(seen)) for i in lost.tolist()), np.int64, len(lost))
    pairs, times = np.unique((np.searchsorted(bounds, lost, side="right") - 1) * max(1, len(seen)) + numbers, return_counts=True)
    texts, numbers = np.divmod(pairs, max(1, len(seen)))
    ends = pa.array(np.searchsorted(texts, np.arange(len(bounds))), pa.int32())
    names = pa.array([w.decode() for w in seen], pa.string()).take(pa.array(numbers))
    return pa.ListArray.from_arrays(ends, names), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))


def encoded(rows: DataFrame, index, unknown: int, total: int, s: Settings) -> DataFrame:
    """``rows`` (id, held_out, text) with a number, their place in the training, their tokens' ranks (16 bits each) and their other words."""
    shards = max(1, -(-total // s.shard))
    place = F.xxhash64(F.col("id").cast("string"), "text")
    kept = ["row", "id", "held_out", "shard", "round", "place"]

    def run(batches):
        for part in bounded(batches, "text"):
            ranks, bounds, tokens = _stretch(part.column(part.schema.get_field_index("text")).to_pylist(), index.value)
            codes = np.where(ranks < 0, unknown, ranks).astype(np.uint16)
            ends = bounds.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(part.schema.get_field_index(c)) for c in kept),
                    pa.array([codes[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary()),
                    *_rare(ranks, bounds, tokens),
                ],
                names=[*kept, "codes", "rare", "times"],
            )

    dealt = rows.select(
        F.monotonically_increasing_id().alias("row"), "id", "held_out", F.pmod(place, F.lit(shards)).alias("shard"),
        F.pmod(F.shiftright(place, 32), F.lit(s.rounds)).alias("round"), place.alias("place"), "text",
    )
    schema = f"row long, id {dict(rows.dtypes)['id']}, held_out boolean, shard long, round long, place long, codes binary, rare array<string>, times array<long>"
    return dealt.mapInArrow(run, schema)


def _joined(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the texts' ranks, one after the other; whether each begins a text)."""
    words = np.frombuffer(b"".join(codes), np.uint16).astype(np.int32)
    begins = np.zeros(len(words), bool)
    begins[np.cumsum([0, *map(len, codes[:-1])]) // 2] = True
    return words, begins


def fit(coded: DataFrame, model: Model, total: int, s: Settings) -> Model:
    """The model after all rounds over the training rows of ``coded``, which have ``total`` tokens."""
    spark = coded.sparkSession
    wide = s.dim + 2
    for number in range(s.rounds if total else 0):
        shared = spark.sparkContext.broadcast(model)

        def learn(table: pa.Table) -> pa.Table:
            copy = deepcopy(shared.value)
            touched = {name: np.zeros(len(x), np.int64) for name, x in copy.p.items()}
            codes = table.column("codes").to_pylist()
            words, begins = _joined([c for _, c in sorted(zip(table.column("place").to_pylist(), codes, strict=True))])
            copy.train(words, begins, np.random.default_rng((s.seed, number, table.column("shard")[0].as_py())), touched)
            at, weights, values = copy.rows(touched)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(values.astype(np.float32).ravel()), wide).cast(pa.list_(pa.float32()))
            return pa.table({"row": pa.array(at), "weight": pa.array(weights.astype(np.float64)), "v": flat})

        copies = coded.where(~F.col("held_out") & (F.col("round") == number)).select("shard", "place", "codes").groupBy("shard").applyInArrow(learn, "row long, weight double, v array<float>")
        sums = [(F.sum(F.col("v")[i] * F.col("weight")) / F.sum("weight")).cast("float") for i in range(wide)]
        merged = copies.groupBy("row").agg(F.array(*sums).alias("v")).toArrow()
        if merged.num_rows:
            values = merged.column("v").combine_chunks().flatten().to_numpy().reshape(-1, wide)
            model.put(merged.column("row").to_numpy(), values)
        shared.destroy()
    release(spark)
    return model


def score(df: DataFrame, id: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Rows whose id's crc32 leaves 1 on division by 5 are held out; all others
    train.  Null and empty texts are a single end token; a null id trains as
    the id ''.  ``base_score`` is the smoothed unigram's and ``score`` the
    model's log10 probability.  Repeated rows are scored, and counted, each.
    Without training rows every word is unknown to both.  Other columns are
    ignored.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).withColumn("held_out", ~is_training(F.col("id")))
    counts = written(word_counts(rows.where(~F.col("held_out"))), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = counts.orderBy(F.desc("n"), "word").limit(min(s.words, 65_535)).toArrow()
    names, tops = frequent.column("word").to_pylist(), frequent.column("n").to_numpy()
    index = spark.sparkContext.broadcast({w.encode(): i for i, w in enumerate(names)})
    k, in_words = len(tops), int(tops.sum())
    log_counts = np.append(np.log10(tops + 0.5), 0.0)  # other words' are joined
    base_norm = log10(total + 0.5 * (distinct + 1))
    other_norm = log10(total - in_words + 0.5 * (distinct - k + 1))
    coded = written(encoded(rows, index, k, total, s), "coded")
    model = fit(coded, Model(tops, total - in_words, s), total, s)
    shared = spark.sparkContext.broadcast(model)

    def apply(batches):
        for part in bounded(batches, "codes", SCORED_BYTES):
            words, begins = _joined(part.column(part.schema.get_field_index("codes")).to_pylist())
            lm = shared.value.log_probs(words, begins) / np.log(10)
            known = (words != k).astype(np.int64)
            sums = [np.add.reduceat(x, np.flatnonzero(begins)) for x in (log_counts.take(words), lm, known, 1 - known, np.ones(len(words), np.int64))]
            kept = [part.column(part.schema.get_field_index(c)) for c in ("row", "id", "held_out")]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, sums)], names=["row", "id", "held_out", "logs", "lm", "n_known", "n_other", "n_tokens"])

    schema = f"row long, id {dict(rows.dtypes)['id']}, held_out boolean, logs double, lm double, n_known long, n_other long, n_tokens long"
    scored = written(coded.select("row", "id", "held_out", "codes").mapInArrow(apply, schema), "scored")
    each = coded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    joined = each.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_logs"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
    )
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    return scored.join(joined, "row", "left").select(
        F.col("id").alias(id),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") + rare_logs - F.col("n_tokens") * F.lit(base_norm)).alias("base_score"),
        (F.col("lm") + rare_logs - F.col("n_other") * F.lit(other_norm)).alias("score"),
    )
