"""Pages, facets, ladders and counts over filtered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowgrid.functions.predicates import RecordQuery


def page(df: DataFrame, sort: str, id: str, descending: bool = True, number: int = 1, size: int = 50) -> DataFrame:
    """One page: nulls last in either direction, ties by id; number and size are at least 1."""
    order = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    number, size = max(1, number), max(1, size)
    return df.orderBy(order, F.asc(id)).offset((number - 1) * size).limit(size)


def facet(df: DataFrame, field: str, query: RecordQuery | None = None, itself: bool = False) -> DataFrame:
    """(value, n) of a field under the query without the field's own axis (``itself`` keeps it); nulls aren't counted."""
    where = query.compile(None if itself else field) if query else F.lit(True)
    return df.where(where & F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n"))


def child_facet(parents: DataFrame, children: DataFrame, key: str, field: str) -> DataFrame:
    """(value, n): distinct parents that have a child with the value."""
    return children.where(F.col(field).isNotNull()).join(parents.select(key), key, "left_semi").groupBy(F.col(field).alias("value")).agg(F.countDistinct(key).alias("n"))


def listed_counts(df: DataFrame, field: str, values: Sequence[str]) -> DataFrame:
    """(value, n) for each listed value, zeros kept."""
    listed = df.sparkSession.createDataFrame([(v,) for v in values], "value string")
    counted = df.groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n"))
    return listed.join(counted, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def predicate_ladder(df: DataFrame, rungs: Sequence[tuple[str, Column]]) -> DataFrame:
    """(rung, name, kept, removed): each rung adds a predicate; one pass over the rows."""
    so_far, sums = F.lit(True), [F.count("*").alias("r0")]
    for k, (_, p) in enumerate(rungs, 1):
        so_far = so_far & F.coalesce(p, F.lit(False))
        sums.append(F.count_if(so_far).alias(f"r{k}"))
    one = df.agg(*sums)
    rows = [
        F.struct(F.lit(k).alias("rung"), F.lit(name).alias("name"), F.col(f"r{k}").alias("kept"), (F.col(f"r{k - 1}") - F.col(f"r{k}")).alias("removed"))
        for k, (name, _) in enumerate(rungs, 1)
    ]
    return one.select(F.inline(F.array(*rows)))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of a rate; null without trials."""
    p = hits / F.nullif(n, F.lit(0))
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def census(df: DataFrame, by: Sequence[str], **metrics: Column) -> DataFrame:
    """Counts and metrics by group: the form of all read-only censuses."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[m.alias(k) for k, m in metrics.items()])


def diff(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of ``after`` that are new, gone or changed against ``before``: (key, change, changed columns)."""
    b = before.select(key, F.struct(*columns).alias("b"))
    a = after.select(key, F.struct(*columns).alias("a"))
    both = b.join(a, key, "full")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")), F.lit(c)) for c in columns]))
    change = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").otherwise("changed")
    out = both.select(key, change.alias("change"), F.when(change == "changed", changed).alias("columns"))
    return out.where((F.col("change") != "changed") | (F.size("columns") > 0))


def facet_or(stored: DataFrame, rows: DataFrame, field: str, query: RecordQuery | None = None) -> DataFrame:
    """(value, n) from stored counts; from the rows where none are stored. One plan: the rows count only if the stored counts are empty."""
    some = stored.agg(F.count("*").alias("__have"))
    counted = facet(rows, field, query).join(F.broadcast(some)).where("__have = 0").drop("__have")
    return stored.select("value", "n").unionByName(counted)


def held_out(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(why, n): rows by the first rule that holds them back; others are 'shown'."""
    why = F.lit("shown")
    for name, p in reversed(list(rules)):
        why = F.when(F.coalesce(p, F.lit(False)), name).otherwise(why)
    return df.groupBy(why.alias("why")).agg(F.count("*").alias("n"))
