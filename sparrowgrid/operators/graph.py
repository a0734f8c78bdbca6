"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sparrowgrid.operators.tables import drop, written


def _stored(edges: DataFrame) -> tuple[DataFrame, dict]:
    """Edges as ``written``, with their number and the sum of their hashes."""
    told = Observation()
    out = written(edges.observe(told, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
    return out, told.get


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: (node, component) for every node that has an edge.

    Alternating large-star and small-star rounds; each round is a partial
    aggregate and a shuffled join, so a hub with many edges is never gathered.
    Rounds grow with the logarithm of the graph's diameter; each is written to
    the shared folder, and what tells whether it changed anything is summed up
    as it is written.  Self-edges and nulls are ignored.
    """
    now, state = _stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        if state == seen:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            out = written(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
            drop(now)
            return out
        seen, before = state, now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, state = _stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        drop(before)
