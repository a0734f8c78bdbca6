"""Merkle manifest of a dataset, with a proof for every row.

A forest is a sparse set of nodes: (tree, level, index) with a digest.  Trees
have a known number of leaves, so it is known which nodes form a run of
siblings; a run that is complete becomes its parent.  Merging two forests is
their union with complete runs closed, which is associative and commutative:
partitions close what they hold, ``treeReduce`` merges what is left open, a
handful of nodes a level at either edge of a partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowgrid.llm.common import drop, settle, written

#: Nodes that share a parent; the last run of a level may hold fewer.
ARITY = 3
#: The tree over the groups' roots; the trees of groups are numbered from 0.
TOP = -1

Node = tuple[int, int, int]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def width(n: int, level: int) -> int:
    """Nodes of a level in a tree of ``n`` leaves."""
    for _ in range(level):
        n = -(-n // ARITY)
    return n


@dataclass
class Forest:
    """Unresolved nodes, and the nodes that runs across partitions were made of."""

    #: Number of leaves of each tree.
    sizes: dict[int, int]
    open: dict[Node, str] = field(default_factory=dict)
    closed: dict[Node, str] = field(default_factory=dict)

    def put(self, nodes: Iterable[tuple[Node, str]]) -> None:
        """Add nodes and close every run that is complete."""
        for node, value in nodes:
            while node:
                self.open[node] = value
                node, value = self._close(node)

    def _close(self, node: Node) -> tuple[Node | None, str | None]:
        """The parent of the node's run, if all of the run is here."""
        tree, level, index = node
        n = width(self.sizes[tree], level)
        if n == 1:
            if tree == TOP:
                return None, None
            # a tree's root is a leaf of the top tree
            self.closed[node] = value = self.open.pop(node)
            return (TOP, 0, tree), value
        first = index // ARITY * ARITY
        run = [(tree, level, i) for i in range(first, min(first + ARITY, n))]
        if any(x not in self.open for x in run):
            return None, None
        values = [self.open.pop(x) for x in run]
        self.closed.update(zip(run, values, strict=True))
        return (tree, level + 1, index // ARITY), digest("".join(values))

    def merge(self, other: Forest) -> Forest:
        """The union of two forests, in the larger one."""
        if len(other.open) + len(other.closed) > len(self.open) + len(self.closed):
            self, other = other, self
        self.sizes |= other.sizes
        self.closed |= other.closed
        self.put(other.open.items())
        return self

    def at(self, node: Node) -> str | None:
        return self.open.get(node) or self.closed.get(node)

    def edge(self) -> Forest:
        """What other partitions may need: the open nodes, with the sizes of their trees and the top one."""
        trees = {TOP, *(tree for tree, _, _ in self.open)}
        return Forest({t: self.sizes[t] for t in trees}, dict(self.open))


def field_text(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field_text, values)), 256)


def placed(leaves: DataFrame, rows_per_part: int) -> DataFrame:
    """``leaves`` (key, id, leaf, ...) with part, tree, index, n (leaves of the tree) and trees.

    Rows are dealt by ranges of (key, id, leaf, turn), so a hot key lies in
    many parts; ranks come from the counts of each key in each part, and every
    window is over the rows of one key's or one part's counts.
    """
    parts = max(1, -(-leaves.count() // rows_per_part))
    order = ["key", F.asc_nulls_first("id"), "leaf", "turn"]
    dealt = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    dealt = written(dealt.withColumn("part", F.shiftright("seq", 33)), "leaves")
    counts = written(dealt.groupBy("key", "part").agg(F.count("*").alias("here"), F.min("seq").alias("first")), "counts")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("key")
    bases = counts.withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0))).withColumn("n", F.sum("here").over(whole))
    # keys are numbered by the part in which they begin, and within it by their first row; the one window over all has a row a part
    starts = bases.where("before = 0").select("key", "part", "first")
    begun = starts.groupBy("part").count().withColumn("earlier", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    trees = counts.select("key").distinct().count()
    number = F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1
    trees_of = starts.withColumn("nth", number).join(begun, "part").select("key", (F.col("earlier") + F.col("nth")).alias("tree"))
    bases = bases.join(trees_of, "key").withColumn("trees", F.lit(trees).cast("long"))
    index = F.col("seq") - F.col("first") + F.col("before")
    out = dealt.join(bases.select("key", "part", "first", "before", "n", "tree", "trees"), ["key", "part"])
    out = written(out.select("part", "tree", index.alias("index"), "n", "trees", *(c for c in leaves.columns if c not in ("key", "turn"))), "placed")
    drop(dealt, counts)
    return out


def _grown(table: pa.Table) -> tuple[Forest, list[Node], list[str]]:
    """The forest of a part's leaves, with the leaves' nodes and digests in the table's order."""
    trees = table["tree"].to_pylist()
    nodes = [(t, 0, i) for t, i in zip(trees, table["index"].to_pylist(), strict=True)]
    values = [x.hex() for x in table["leaf"].to_pylist()]
    forest = Forest(dict(zip(trees, table["n"].to_pylist(), strict=True)) | {TOP: table["trees"][0].as_py()})
    forest.put(zip(nodes, values, strict=True))
    return forest, nodes, values


def _fragment(table: pa.Table) -> pa.Table:
    """A part's unresolved nodes as rows."""
    edge = _grown(table)[0].edge()
    nodes = list(edge.open)
    columns = {name: pa.array([x[k] for x in nodes], pa.int64()) for k, name in enumerate(("tree", "level", "index"))}
    sizes = pa.array([edge.sizes[x[0]] for x in nodes], pa.int64()), pa.array([edge.sizes[TOP]] * len(nodes), pa.int64())
    return pa.table({"part": pa.array([table["part"][0].as_py()] * len(nodes), pa.int64()), **columns, "n": sizes[0], "trees": sizes[1], "value": pa.array(list(edge.open.values()))})


def _forest(rows) -> Forest:
    """One forest of a task's rows of ``_fragment``."""
    forest = Forest({})
    for r in rows:
        forest.sizes |= {r["tree"]: r["n"], TOP: r["trees"]}
        forest.put([((r["tree"], r["level"], r["index"]), r["value"])])
    return forest


FIELDS = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proofs(table: pa.Table, spine: Forest, root: str, own: list[str]) -> pa.Table:
    """Proof and verification of every leaf of a part: nodes come from the part itself, those of runs across parts from the spine."""
    forest, nodes, values = _grown(table)

    def at(node: Node) -> str:
        return forest.at(node) or spine.at(node)

    sizes = forest.sizes
    shared: dict[Node, tuple[str, list[tuple[str, str]]]] = {}

    def above(node: Node) -> list[tuple[str, str]]:
        """Siblings (left, right) of the node and of all nodes above it; runs of siblings share what is above them."""
        tree, level, index = node
        while (n := width(sizes[tree], level)) == 1:
            if tree == TOP:
                return []
            tree, level, index = TOP, 0, tree
        up = (tree, level + 1, index // ARITY)
        if up not in shared:
            shared[up] = above(up)
        first = index // ARITY * ARITY
        run = [at((tree, level, i)) for i in range(first, min(first + ARITY, n))]
        return [("".join(run[: index - first]), "".join(run[index - first + 1 :])), *shared[up]]

    subroots: dict[int, str] = {}

    def subroot(tree: int) -> str:
        if tree not in subroots:
            level = 0
            while width(sizes[tree], level) > 1:
                level += 1
            subroots[tree] = at((tree, level, 0))
        return subroots[tree]

    tampered = [x and x.hex() for x in table["tampered"].to_pylist()]
    out = []
    for node, value, other in zip(nodes, values, tampered, strict=True):
        path = above(node)
        folded = other or value
        for left, right in path:
            folded = digest(left + folded + right)
        out.append((value, subroot(node[0]), root, digest("".join(left + right for left, right in path)), folded, folded == root))
    names = [f.split()[0] for f in FIELDS.split(", ")]
    made = [pa.array(c, pa.bool_() if n == "verified" else pa.string()) for n, c in zip(names, zip(*out, strict=True), strict=True)]
    return pa.table({**{c: table[c] for c in own}, **dict(zip(names, made, strict=True))})


def manifest(docs: DataFrame, rows_per_part: int = 1 << 16) -> DataFrame:
    """One row per document: its leaf, the roots above it, its proof and whether the (partly tampered) document verifies.

    ``docs`` has doc_id, source, lang, n_chars and text; other columns are
    ignored, whatever they are called.  Nulls are leaves' fields like others; a
    null source is a tree of its own, before all others, and rows with a null
    doc_id come first in their tree (and are not tampered with).  Rows that
    repeat a doc_id are leaves of their own, in the order of their digests.  No
    documents give no rows.

    ``rows_per_part`` bounds what a task holds.  The driver holds the nodes of
    runs across parts: about twice the arity a level and part, whatever the
    number of rows in a part or of sources.
    """
    spark = docs.sparkSession
    settle(spark)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    tampers = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains(text, F.lit("\n"))
    leaves = docs.select(
        # keeps a null source apart from '' and before it
        F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0")).alias("key"),
        F.col("doc_id").alias("id"),
        F.unhex(leaf(*fields, text)).alias("leaf"),
        F.when(tampers, F.unhex(leaf(*fields, F.replace(text, F.lit("\n"), F.lit(""))))).alias("tampered"),
        F.monotonically_increasing_id().alias("turn"),
    )
    leaves = written(leaves, "hashed")
    rows = placed(leaves, rows_per_part)
    edges = rows.groupBy("part").applyInArrow(_fragment, "part long, tree long, level long, index long, n long, trees long, value string")
    parts = edges.rdd.mapPartitions(lambda it: [_forest(it)])
    spine = parts.treeReduce(Forest.merge, depth=3) if rows.take(1) else Forest({TOP: 0})
    root = next(iter(spine.open.values()), "")
    shared = spark.sparkContext.broadcast((spine, root))
    out = rows.groupBy("part").applyInArrow(lambda t: _proofs(t, *shared.value, ["id"]), f"id {rows.schema['id'].dataType.simpleString()}, {FIELDS}")
    drop(leaves)
    return out.withColumnRenamed("id", "doc_id")
