"""Near-duplicate embeddings through a pivot-permutation index.

Reference points are a bounded, hash-ordered sample of the distinct vectors.
Every vector is described by its nearest reference points in order (its
permutation), and posted to the inverted lists of these points.  Vectors
that share enough of their nearest points are candidates; since they must share
one of their rarest points but few, a vector is in that many lists only, and
every list counts the shared points of its pairs.  A pair is verified, in
double precision, in the list of the first point that it shares.  Links are
summed per vector and joined into components inside the tasks: pairs are never
written out.

The exact mode needs no luck: a vector is at home in the list of its nearest
point and a guest in every list where, by the triangle inequality of angles, a
vector that it links with can be at home.
"""

from __future__ import annotations

from math import acos, isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowgrid.llm.common import components, drop, release, written

#: Vectors in one block of a list.
BLOCK = 1024


def fit_pivots(distinct: DataFrame, total: int, least: int = 64, most: int = 8192) -> dict[int, np.ndarray]:
    """Reference points by dimension: about twice the square root of ``total``, between ``least`` and ``most`` rows of the sample."""
    count = min(most, max(least, 2 * isqrt(total)))
    sample = distinct.orderBy(F.xxhash64("rep"), "rep").limit(count).select("vector").toArrow().column(0).to_pylist()
    found: dict[int, list] = {}
    for v in sample:
        found.setdefault(len(v), []).append(v)
    out = {}
    for size, vectors in found.items():
        x = np.array(vectors, np.float64)
        out[size] = x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def cosines(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return x @ pivots.T / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """The permutation of each row: its ``m`` nearest pivots, nearest first (ties: the lower pivot)."""
    sims = cosines(x, pivots)
    if m < sims.shape[1]:
        # the m-th cosine and all above it, then in order
        border = np.partition(sims, -m, axis=1)[:, [-m]]
        sims = np.where(sims >= border, sims, -2.0)
    return np.argsort(-sims, axis=1, kind="stable")[:, :m]


def places(m: int, pivots: int) -> int:
    """Length of the permutations: a few more where there are many pivots, so that recall stays."""
    return m if pivots <= 2048 else m + 2


def compare(x: np.ndarray, near: np.ndarray, side: np.ndarray, here: int, shared: int, limit: float) -> np.ndarray:
    """The pairs that this list links: they share ``shared`` points or more and none that comes before ``here``.

    ``near`` holds the places of each row's points in the order of the lists;
    ``side`` is 0 for the first block of the pair, 1 for the second, 2 where
    both are the same block.
    """
    points, columns = np.unique(near, return_inverse=True)
    has = np.zeros((len(x), len(points)), np.float32)
    np.put_along_axis(has, columns.reshape(near.shape), 1, axis=1)
    before = has[:, points < here]
    candidates = (has @ has.T >= min(shared, near.shape[1])) & (before @ before.T == 0)
    return candidates & _close(x, side, limit)


def _close(x: np.ndarray, side: np.ndarray, limit: float) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1)
    links = (x @ x.T) / (norms[:, None] * norms[None, :]) >= limit
    np.fill_diagonal(links, False)
    if not (side == 2).all():
        links &= side[:, None] != side[None, :]
    return links


def _labels(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id each row reaches inside the block."""
    labels = ids.copy()
    while True:
        new = np.minimum(labels, np.where(links, labels[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == labels).all():
            return labels
        labels = new


def near_duplicates(
    df: DataFrame, id: str = "vec_id", vector: str = "embedding", limit: float = 0.9, m: int = 8, shared: int = 2, most: int = 8192, exact: bool = False
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, and vectors of different lengths don't link.  Equal
    vectors are one entry of the index with a weight, so a large group of
    copies costs one comparison.  Repeated rows count as vectors of their own;
    a null id links with nothing.  Other columns are ignored.  Pairs that share
    fewer than ``shared`` of their ``m`` nearest points are missed (``exact``:
    none is, at the price of more comparisons).
    """
    plain = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast(plain).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    distinct = written(usable.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("weight")), "vectors")
    pivots = fit_pivots(distinct, distinct.count(), most=most)
    reach = acos(max(-1.0, min(1.0, limit))) + 1e-9

    def points_of(size: int) -> np.ndarray:
        # a length that the sample lacks has two points of its own
        return pivots.get(size, np.eye(size)[:2] if size > 1 else np.ones((1, 1)))

    def tables(batches):
        """(batch, rows of one length, the length, the vectors) of all batches, about 2,000 rows at a time."""
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("vector"))
            starts = vectors.offsets.to_numpy()
            flat, lengths = vectors.values.to_numpy(zero_copy_only=False), np.diff(starts)
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                for part in np.array_split(at, -(-len(at) // 2000)):
                    yield batch, part, int(size), flat[starts[part][:, None] + np.arange(size)[None, :]].astype(np.float64)

    def describe(batches):
        for batch, part, size, x in tables(batches):
            points = points_of(size)
            if exact:
                angles = np.arccos(np.clip(cosines(x, points), -1, 1))
                guests = (angles <= angles.min(axis=1, keepdims=True) + 2 * reach).sum(axis=1)
                near = [a[:n] for a, n in zip(np.argsort(angles, axis=1, kind="stable"), guests.tolist(), strict=True)]
            else:
                near = list(nearest(x, points, min(len(points), places(m, len(points)))))
            kept = pa.array(part)
            offsets = np.append(0, np.cumsum([len(v) for v in near])).astype(np.int32)
            columns = [batch.column(batch.schema.get_field_index(c)).take(kept) for c in ("rep", "weight", "vector")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.full(len(part), size), pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(near), pa.int32()))],
                names=["rep", "weight", "vector", "size", "near"],
            )

    described = written(distinct.mapInArrow(describe, f"rep long, weight long, vector {plain}, size int, near array<int>"), "described")
    drop(distinct)
    # as many lists as pivots
    counts = described.select("size", F.explode("near").alias("point")).groupBy("size", "point").agg(F.count("*").alias("n")).toArrow()
    lengths = {(s, p): n for s, p, n in zip(*(counts.column(c).to_pylist() for c in ("size", "point", "n")), strict=True)}
    order = {s: {} for s, _ in lengths}  # rare lists first
    for s, p in sorted(lengths, key=lambda x: (x[0], lengths[x], x[1])):
        order[s][p] = len(order[s])
    names = ["key", "low", "high", "side", "home", "rep", "weight", "near", "vector"]

    def post(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            reps, nears = batch.column(0).to_pylist(), batch.column(4).to_pylist()
            places_ = []
            for row, (rep, size, near) in enumerate(zip(reps, batch.column(3).to_pylist(), nears, strict=True)):
                ranks = order[size]
                ranked = [(ranks[p], p) for p in near]
                places_.append([0] if exact else sorted(r for r, _ in ranked))
                first = near[0]
                lists = ranked if exact else sorted(ranked)[: max(1, len(near) - shared + 1)]
                for rank, p in lists:
                    blocks = -(-lengths[size, p] // BLOCK)
                    mine = xxhash.xxh64_intdigest(rep.to_bytes(8, "little", signed=True)) % blocks
                    for other in range(blocks if lengths[size, p] > 1 else 0):
                        for held, v in zip(out, ((size << 32) | rank, min(mine, other), max(mine, other), 2 if mine == other else 0 if mine < other else 1, p == first, row), strict=True):
                            held.append(v)
            which = pa.array(out[5], pa.int64())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(c, t) for c, t in zip(out, kinds, strict=False)),
                    *(batch.column(i).take(which) for i in (0, 1)),
                    pa.array(places_, pa.list_(pa.int32())).take(which),
                    batch.column(2).take(which),
                ],
                names=names,
            )

    posted = described.mapInArrow(post, f"key long, low long, high long, side int, home boolean, rep long, weight long, near array<int>, vector {plain}")

    def verify(batches):
        now, held = None, []

        def close():
            side, home = np.array([r[0] for r in held]), np.array([r[1] for r in held])
            ids, weights = np.array([r[2] for r in held], np.int64), np.array([r[3] for r in held], np.int64)
            x = np.array([r[5] for r in held], np.float64)
            if exact:
                links = _close(x, side, limit)
                n = np.where(home, links @ weights, 0)  # a vector's own list sees all its links
            else:
                links = compare(x, np.array([r[4] for r in held]), side, now[0] & 0xFFFFFFFF, shared, limit)
                n = links @ weights
            some = links.any(axis=1)
            if not some.any():
                return None
            labels = _labels(links[some][:, some], ids[some])
            return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(labels), pa.array(n[some])], names=["rep", "label", "n"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(8)]
            vectors = batch.column(8)
            for i, group in enumerate(zip(*columns[:3], strict=True)):
                if group != now:
                    if held and (found := close()) is not None:
                        yield found
                    now, held = group, []
                held.append((*(columns[k][i] for k in range(3, 8)), vectors[i].values.to_numpy(zero_copy_only=False)))
        if held and (found := close()) is not None:
            yield found

    ordered = posted.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    found = written(ordered.mapInArrow(verify, "rep long, label long, n long"), "links")
    release(df.sparkSession)
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    groups = components(found, "rep", "label").select(F.col("node").alias("rep"), "component")
    reps = described.join(counts, "rep", "left").join(groups, "rep", "left").select(
        "vector", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    ready = F.when(F.col("id").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.col("vector"))
    out = rows.select("id", ready.alias("vector")).join(reps, "vector", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )
