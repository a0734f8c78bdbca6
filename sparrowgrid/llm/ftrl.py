"""Quality classifier: logistic regression over hashed word n-grams, trained online by follow-the-regularised-leader.

Features are n-grams of words (lower-cased) and of word shapes (letters, digits
and symbols in the order in which their kinds change, and whether the word is
the one before), so that the model also judges words that no labelled document
has.  Each family of n-grams is hashed into columns of its own, and a column's
value is the square root of its share in the family, whatever the text's length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowgrid.llm.common import bounded, settle

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Kinds of bytes in a shape: small letters (and all beyond ASCII), capitals, digits; other bytes stand for themselves.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = _KIND[128:] = ord("a")
_KIND[65:91] = ord("A")
_KIND[48:58] = ord("0")
#: Multiplier of the rolling hash, its inverse modulo 2^64 and the mixing constants.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))
#: Bytes that are hashed at a time; a longer text is cut between words.
SEGMENT = 1 << 20


@dataclass(frozen=True)
class Settings:
    """Parameters of the model and its training."""

    #: Each family has 2^bits columns; a model has that many weights a family and one for all documents.
    bits: int = 18
    words: tuple[int, ...] = (1, 2)
    shapes: tuple[int, ...] = (1, 2, 3)
    #: At most so many labelled documents are learned from, those whose ids have the smallest hashes.
    sample: int = 16_384
    passes: int = 2
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    threshold: float = 0.7

    @property
    def families(self) -> tuple[tuple[str, int], ...]:
        return tuple(("word", n) for n in self.words) + tuple(("shape", n) for n in self.shapes)

    @property
    def columns(self) -> int:
        return (len(self.families) << self.bits) + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * _MIX[0]
    x = (x ^ (x >> U(27))) * _MIX[1]
    return x ^ (x >> U(31))


def _spans_hashed(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for every span, from prefix sums of a polynomial modulo 2^64."""
    powers = np.full(len(values) + 1, _BASE, U)
    powers[0] = 1
    powers = np.cumprod(powers)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum((values.astype(U) + U(1)) * powers[:-1], out=sums[1:])
    back = np.full(len(values) + 1, _INVERSE, U)
    back[0] = 1
    return _mixed((sums[ends] - sums[starts]) * np.cumprod(back)[starts])


def _segment(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, word hash, shape hash) of the words of ``data``; ``begins`` are places at which a document starts."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = begins[begins < len(data)]
    first[begins] |= inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    word = _spans_hashed(_LOWER[data], starts, ends)
    kind = _KIND[data]
    kept = inside.copy()
    kept[1:] &= (kind[1:] != kind[:-1]) | first[1:]
    rank = np.concatenate([[0], np.cumsum(kept)])
    return starts, word, _spans_hashed(kind[kept], rank[starts], rank[ends])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word hash, shape hash) of all words of the texts data[offsets[i]:offsets[i + 1]]."""
    out, at = [], 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        if end < len(data):  # on to the next white space
            while end < len(data) and not (gap := _SPACE[data[end : end + SEGMENT]]).any():
                end += len(gap)
            if end < len(data):
                end += int(gap.argmax())
        begins = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
        place, word, shape = _segment(data[at:end], begins)
        out.append((place + at, word, shape))
        at = end
    place, word, shape = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U))
    doc = np.searchsorted(offsets, place, "right") - 1
    again = np.zeros(len(doc), bool)
    again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    return doc, word, np.where(again, ~shape, shape)


def features(data: np.ndarray, offsets: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sparse matrix of the texts as (document, column, value); no pair of document and column comes twice."""
    doc, word, shape = tokens(data, offsets)
    n_docs, bits = len(offsets) - 1, settings.bits
    docs, columns, values = [np.arange(n_docs)], [np.full(n_docs, settings.columns - 1)], [np.ones(n_docs)]
    for k, (kind, n) in enumerate(settings.families):
        hashes = word if kind == "word" else shape
        grams = hashes[: len(hashes) - n + 1]
        for i in range(1, n):
            grams = _mixed(grams * U(_BASE) + hashes[i : len(hashes) - n + 1 + i])
        of = doc[: len(grams)]
        whole = of == doc[n - 1 :] if len(grams) else np.zeros(0, bool)
        of, grams = of[whole], grams[whole]
        keys, counts = np.unique((of.astype(np.int64) << bits) | (_mixed(grams ^ U(k + 1)) >> U(64 - bits)).astype(np.int64), return_counts=True)
        of = keys >> bits
        docs.append(of)
        columns.append((keys & ((1 << bits) - 1)) + (k << bits))
        values.append(np.sqrt(counts / np.bincount(doc[: len(whole)][whole], minlength=n_docs)[of]))
    return np.concatenate(docs), np.concatenate(columns), np.concatenate(values)


class Leader:
    """Follow-the-regularised-leader with a learning rate for every column; weights are made when they are asked for."""

    def __init__(self, settings: Settings):
        self.s = settings
        self.z = np.zeros(settings.columns)
        self.n = np.zeros(settings.columns)

    def weights(self, columns=slice(None)) -> np.ndarray:
        z, s = self.z[columns], self.s
        pull = np.maximum(np.abs(z) - s.l1, 0)
        return -np.sign(z) * pull / ((s.beta + np.sqrt(self.n[columns])) / s.alpha + s.l2)

    def learn(self, columns: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(columns)
        slope = (_chance(w @ values) - label) * values
        n = self.n[columns]
        self.z[columns] += slope - (np.sqrt(n + slope**2) - np.sqrt(n)) / self.s.alpha * w
        self.n[columns] = n + slope**2


def _chance(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of strings, null as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def sampled(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """(turn, doc_id, text, label): labelled documents to learn from, ``settings.sample`` labels at most.

    The smallest hashes of ids are taken, which is the same sample however rows
    are partitioned.  Ids whose labels contradict each other are left out.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
    known = known.agg(F.min("quality").cast("int").alias("label"), F.max("quality").cast("int").alias("other")).where("label = other").drop("other")
    turn = F.xxhash64(F.col("id").cast("string"))
    # bounded by settings.sample rows of three numbers
    picked = F.broadcast(known.withColumn("turn", turn).orderBy("turn", "id").limit(settings.sample))
    return docs.select(F.col("doc_id").alias("id"), "text").join(picked, "id").select("turn", "id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """The weights learned from the labelled ones of ``docs`` (doc_id, text; ``labels`` has doc_id and quality).

    One task streams the bounded sample; the driver gets its weights, whose
    number is a parameter.  Without labelled documents all weights are 0.
    """
    settle(docs.sparkSession)

    def train(batches):
        leader, seen = Leader(settings), []
        for batch in batches:
            for part in bounded([batch], "text"):
                labels_here = part.column("label").to_pylist()
                of, columns, values = features(*_texts(part.column("text")), settings)
                order = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[order], np.arange(1, len(labels_here)))
                for label, c, v in zip(labels_here, np.split(columns[order], cuts), np.split(values[order], cuts), strict=True):
                    leader.learn(c, v, label)
                    if settings.passes > 1:
                        seen.append((label, c.astype(np.int32), v.astype(np.float32)))
        for _ in range(settings.passes - 1):
            for label, c, v in seen:
                leader.learn(c, v.astype(float), label)
        w = leader.weights()
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["column", "weight"])

    rows = sampled(docs, labels, settings).repartition(1).sortWithinPartitions("turn", "id", "text")
    learned = rows.mapInArrow(train, "column long, weight double").toArrow()
    weights = np.zeros(settings.columns, np.float32)
    weights[learned.column("column").to_numpy()] = learned.column("weight").to_numpy()
    return weights


def score(df: DataFrame, weights: np.ndarray, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """``df`` without its text, with ``score`` (chance of label 1) and ``predicted``; every row stays.

    A null text counts as empty, and a text without words has the score of the
    bias.  Columns of ``df`` called like an output are replaced.
    """
    keep = [c for c in df.columns if c not in ("score", "predicted")]
    if text not in keep:
        raise ValueError(f"the text column may not be called {text!r}")
    rest = [c for c in keep if c != text]
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for part in bounded(batches, text):
            of, columns, values = features(*_texts(part.column(text)), settings)
            chance = _chance(np.bincount(of, w[columns] * values, part.num_rows))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(chance)], names=[*rest, "score"])

    schema = df.select(*rest).schema.add("score", "double")
    out = df.select(*keep).mapInArrow(run, schema)
    return out.withColumn("predicted", (F.col("score") >= settings.threshold).cast("int"))


def held_out(doc_id="doc_id"):
    """Rows that nothing is learned from: a quarter of the ids, by their checksum."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learned from the labels of ids that aren't held out.

    ``docs`` has doc_id and text; other columns are ignored, whatever they are
    called.  Repeated rows are learned from and scored as often as they come.
    A null doc_id has no label and isn't held out.  No documents give no rows.
    """
    docs, labels = docs.select("doc_id", "text"), labels.select("doc_id", "quality")
    weights = fit(docs, labels.where(~held_out()), settings)
    return score(docs, weights, settings).select("doc_id", held_out().alias("held_out"), "score", "predicted")
