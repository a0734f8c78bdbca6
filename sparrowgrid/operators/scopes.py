"""Semi-join scopes, membership gates and relation walks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sparrowgrid.functions.predicates import fold

# The most neighbours in a list that travels, and into how many parts a value's ids and all pairs are dealt.
LIST, PARTS, ROUNDS = 256, 24, 4


def holding(parents: DataFrame, children: DataFrame, key: str, where: Column) -> DataFrame:
    """Parents that have a child for which the predicate holds."""
    return parents.join(children.where(where).select(key), key, "left_semi")


def per_axis(parents: DataFrame, children: DataFrame, key: str, axes: Mapping[str, Sequence]) -> DataFrame:
    """Parents that, for every axis, have some child with a listed value: the children may differ by axis.

    An empty or missing list leaves its axis open.
    """
    for field, values in axes.items():
        if values:
            parents = holding(parents, children, key, F.col(field).isin(*values))
    return parents


def matched_axes(parents: DataFrame, children: DataFrame, key: str, axes: Mapping[str, Sequence[str]]) -> DataFrame:
    """(key, matched): for each parent the ``axis:value`` labels that its children meet, sorted."""
    labels = [F.when(fold(c).isin(*[v.lower() for v in vs]), F.concat(F.lit(f"{c}:"), fold(c))) for c, vs in axes.items()]
    told = children.select(key, F.explode(F.array_compact(F.array(*labels))).alias("label"))
    per = told.groupBy(key).agg(F.sort_array(F.collect_set("label")).alias("matched"))
    return parents.select(key).join(per, key, "left").select(key, F.coalesce("matched", F.array().cast("array<string>")).alias("matched"))


def included(parents: DataFrame, membership: DataFrame, key: str, status: str = "status") -> tuple[DataFrame, DataFrame]:
    """(included, unconfirmed): parents with an included membership, and those with none of any status."""
    return (
        parents.join(membership.where(F.col(status) == "included").select(key), key, "left_semi"),
        parents.join(membership.select(key), key, "left_anti"),
    )


def related(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(a, other, shared, links): two-hop neighbours over shared ``b``; ``links`` counts edge rows, ``shared`` distinct ones.

    Edges are dealt by ``b`` once, and counted by (a, b) there, so a hub with many repeated edges is one row a neighbour.
    A pair is counted once for both its directions, at the smaller of the two: the larger ones of a value
    travel there in lists of ``LIST`` at most, as distances of two bytes where those do; counts travel unless all are 1.
    """
    kind = edges.schema[a].dataType
    counted = edges.select(F.col(a).alias("x"), F.col(b).alias("b")).where("x is not null and b is not null").repartition("b").groupBy("b", "x").agg(F.count("*").alias("w"))
    nth = F.row_number().over(Window.partitionBy("b").orderBy("x")) - 1
    lists = counted.withColumn("i", F.floor(nth / LIST)).groupBy("b", "i").agg(F.sort_array(F.collect_list(F.struct("x", "w"))).alias("of")).select("b", "i", "of.x", "of.w")
    base, near, steps = F.lit(None).cast(kind), F.lit(False), F.lit(None).cast("array<short>")
    if isinstance(kind, IntegralType):
        base = F.col("x")[0]
        near = F.coalesce(F.call_function("try_subtract", F.element_at("x", -1), base) < 1 << 15, F.lit(False))
        steps = F.transform("x", lambda x: (x - F.col("x")[0]).cast("short"))
    several = F.when(F.array_max("w") > 1, F.col("w"))
    lists = lists.select("b", "i", "x", several.alias("w"), F.when(near, base).alias("base"), F.when(near, steps).alias("near"), F.when(~near, F.col("x")).alias("far"))
    mine = lists.select("b", F.col("i").alias("at"), F.col("x").alias("a"), F.col("w").alias("wa"))
    both = mine.hint("merge").join(lists.drop("x"), "b").where("at <= i").select("*", F.posexplode("a").alias("n", "one"))
    # in its own list a value meets those behind it, in later lists all
    behind = lambda c: F.slice(c, F.when(F.col("at") == F.col("i"), F.col("n") + 2).otherwise(1), LIST)
    far, w, wa = behind("far"), behind("w"), F.get("wa", "n")
    rest = F.when(far.isNotNull() | w.isNotNull() | wa.isNotNull(), F.struct(far.alias("far"), w.alias("w"), wa.alias("wa")))
    met = both.select(F.col("one").alias("a"), "base", behind("near").alias("near"), rest.alias("rest")).where("size(coalesce(near, array())) > 0 or size(coalesce(rest.far, array())) > 0").repartition("a")
    each = met.select("a", "base", F.col("rest.wa").alias("wa"), F.inline(F.arrays_zip(*[F.coalesce(c, F.array().cast(of)).alias(c.split(".")[-1]) for c, of in (("near", "array<short>"), ("rest.far", f"array<{kind.simpleString()}>"), ("rest.w", "array<long>"))])))
    x = F.coalesce("far", F.col("base") + F.col("near")).cast(kind) if isinstance(kind, IntegralType) else F.col("far")
    each = each.select("a", F.coalesce("wa", F.lit(1)).alias("wa"), x.alias("x"), F.coalesce("w", F.lit(1)).alias("w"))
    pairs = each.groupBy("a", "x").agg(F.count("*").alias("shared"), F.sum("w").alias("links"), F.sum("wa").alias("back"))
    way = lambda p, q, n: F.struct(F.col(p).alias(a), F.col(q).alias("other"), "shared", F.col(n).alias("links"))
    return pairs.select(F.inline(F.array(way("a", "x", "links"), way("x", "a", "back"))))


def related_by(rows: DataFrame, id: str, axes: Sequence[str]) -> DataFrame:
    """(id, other, reasons): pairs of ids that share a value of one of the ``axes``, with all axes on which they do, in order.

    A pair is made once, at the first value of the first axis that both have, so
    pairs are never shuffled; a value's ids are dealt to ``PARTS`` tasks, each of
    which meets all of them.
    """
    sets = rows.where(F.col(id).isNotNull()).groupBy(id).agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in axes])
    mine = sets.select(F.col(id).alias("a"), *[F.col(c).alias(f"a_{k}") for k, c in enumerate(axes)])
    yours = sets.select(F.col(id).alias("b"), *[F.col(c).alias(f"b_{k}") for k, c in enumerate(axes)])
    met = lambda k: F.arrays_overlap(f"a_{k}", f"b_{k}")
    out = None
    for k in range(len(axes)):
        part = F.pmod(F.xxhash64("a"), F.lit(PARTS)).cast("int")
        left = mine.withColumn("v", F.explode(f"a_{k}")).withColumn("part", part).repartition(ROUNDS * PARTS, "v", "part")
        right = yours.withColumn("v", F.explode(f"b_{k}")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).repartition(ROUNDS * PARTS, "v", "part")
        first = F.when((F.size(f"a_{k}") == 1) | (F.size(f"b_{k}") == 1), F.lit(True)).otherwise(F.array_min(F.array_intersect(f"a_{k}", f"b_{k}")) == F.col("v"))
        pairs = left.hint("merge").join(right, ["v", "part"]).where((F.col("a") != F.col("b")) & first)
        for j in range(k):
            pairs = pairs.where(~met(j))
        why = F.concat_ws(",", *[F.lit(axes[k])], *[F.when(met(j), F.lit(axes[j])) for j in range(k + 1, len(axes))])
        pairs = pairs.select(F.col("a").alias(id), F.col("b").alias("other"), why.alias("reasons"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def history(edges: DataFrame, project: str, party: str) -> DataFrame:
    """(project, party, others, first_other): how many other projects each party of a project has, and the smallest of them.

    A party's count and its two smallest projects say it for all its projects, so no pairs are made.
    """
    known = edges.select(project, party).dropna().distinct()
    per = known.groupBy(party).agg(F.count("*").alias("__n"), F.min(project).alias("__first"))
    second = known.join(per, party).where(F.col(project) > F.col("__first")).groupBy(party).agg(F.min(project).alias("__second"))
    # a party without a second project is no one's history
    rows = known.join(per.join(second, party), party)
    other = F.when(F.col(project) == F.col("__first"), F.col("__second")).otherwise(F.col("__first"))
    return rows.select(project, party, (F.col("__n") - 1).alias("others"), other.alias("first_other"))


def repoint(edges: DataFrame, merges: DataFrame, node: str, rest: Sequence[str]) -> DataFrame:
    """Edges after losers are merged into winners: repointed, or gone where the winner has the same edge already.

    ``merges`` has loser and winner.
    """
    moved = edges.join(merges.select(F.col("loser").alias(node), "winner"), node, "left")
    return moved.select(F.coalesce("winner", node).alias(node), *rest).distinct()
