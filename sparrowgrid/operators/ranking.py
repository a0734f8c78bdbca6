"""Window-style operators: first wins, caps with counts of the rest, samples, guards, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowgrid.operators.tables import written


def first_wins(df: DataFrame, key: str | Sequence[str], *order: str | Column) -> DataFrame:
    """The first row of each key in the given order.

    An aggregate, not a window: a key with very many rows is reduced before the shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])).alias("__row"))
    return first.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def last_wins(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The row of each key that is last in the given order."""
    rest = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])).alias("__row"))
    return last.select(*[F.col(c) if c == key else F.col(f"__row.{c}").alias(c) for c in df.columns])


def capped(df: DataFrame, group: str, cap: int, *order: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, held): at most ``cap`` rows a group in order, with their rank, and how many each group held back."""
    rows = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= cap)
    held = df.groupBy(group).agg(F.greatest(F.count("*") - cap, F.lit(0)).alias("held"))
    return rows, held


def group_weight(df: DataFrame, group: str) -> DataFrame:
    """With the group's number of rows, for sorting groups by size."""
    return df.join(df.groupBy(group).agg(F.count("*").alias("weight")), group)


def frequency_guard(df: DataFrame, key: str, least: int = 1, most: int | None = None) -> DataFrame:
    """Rows whose key is found at least and at most so often."""
    counts = df.groupBy(key).agg(F.count("*").alias("__n"))
    kept = counts.where((F.col("__n") >= least) & (F.col("__n") <= most if most is not None else F.lit(True)))
    return df.join(kept.select(key), key, "left_semi")


def ranked(df: DataFrame, stratum: str, *order: str) -> DataFrame:
    """``rank`` from 0 and ``size`` within the stratum, for strata that no task could hold.

    Rows are dealt by ranges of (stratum, order) and written; a row's rank is
    its place in its partition and the rows of its stratum in the partitions
    before.
    """
    rows = df.repartitionByRange(stratum, *order).sortWithinPartitions(stratum, *order)
    placed = written(rows.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("__part"), stratum).agg(F.count("*").alias("__n"), F.min(place).alias("__first"))
    w = Window.partitionBy(stratum)
    before = F.sum("__n").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__part", F.col(stratum).alias("__stratum"), (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__offset"), F.sum("__n").over(w).alias("size"))
    joined = placed.withColumn("__p", part).join(offsets, (F.col("__p") == F.col("__part")) & F.col(stratum).eqNullSafe(F.col("__stratum")))
    return joined.select(*df.columns, (place + F.col("__offset")).alias("rank"), "size")


def strided_by(df: DataFrame, stratum: str, size: int, *order: str) -> DataFrame:
    """A systematic sample of each stratum: the rows at floor(i * n / size)."""
    return ranked(df, stratum, *order).where(_on_stride(F.col("rank"), F.col("size"), size)).select(*df.columns)


def _on_stride(i: Column, n: Column, size: int) -> Column:
    # i = floor(k * n / size) for the k that is the least with k * n / size >= i
    k = F.ceil(i * size / n)
    return (F.lit(size) >= n) | ((k < size) & (F.floor(k * n / size) == i))


def quotas(df: DataFrame, stratum: str, total: int) -> DataFrame:
    """(stratum, n, quota): proportional, one at least, rounded by largest remainder, ties by name."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("n"))
    exact = sizes.withColumn("exact", F.col("n") * total / F.sum("n").over(Window.partitionBy())).withColumn("low", F.greatest(F.floor("exact"), F.lit(1)))
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("exact") - F.floor("exact")), F.asc(stratum)))
    left = F.lit(total) - F.sum("low").over(Window.partitionBy())
    return exact.select(stratum, "n", (F.col("low") + F.when(rank <= left, 1).otherwise(0)).cast("long").alias("quota"))


def mode_first_seen(df: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """(key, mode, n): the most frequent value; ties go to the one seen first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(ordinal).alias("first"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias("mode"), F.max("n").alias("n"))


def disambiguate(df: DataFrame, name: str, *suffixes: str) -> DataFrame:
    """``label``: the name, with the first suffix that is set and unique within its group of equal names if the name repeats.

    Counts are aggregates joined back, so one very common name is no single task's work.
    """
    out = df.join(df.groupBy(name).agg(F.count("*").alias("__all")), name)
    labels = []
    for k, s in enumerate(suffixes):
        alone = df.where(F.col(s).isNotNull()).groupBy(name, s).agg(F.count("*").alias(f"__n{k}")).where(F.col(f"__n{k}") == 1)
        out = out.join(alone, [name, s], "left")
        labels.append(F.when(F.col(f"__n{k}").isNotNull(), F.concat(F.col(name), F.lit(" ("), F.col(s).cast("string"), F.lit(")"))))
    label = F.when(F.col("__all") > 1, F.coalesce(*labels, F.col(name))).otherwise(F.col(name))
    return out.select(*df.columns, label.alias("label"))


def best_alternative(rows: DataFrame, key: str, source: str, order: Sequence[str]) -> DataFrame:
    """Of each key's rows the one whose source comes first in ``order``; other sources count after those, by name."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(source))
    rank = F.struct(F.when(place > 0, place).otherwise(len(order) + 1), source)
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), rank).alias("__best")).select(key, "__best.*")


def top_block(df: DataFrame, key: str, most: int, *order: str | Column, value: str) -> DataFrame:
    """(key, shown, held): each key's first ``most`` values in order, and how many rows come after them."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = df.withColumn("__k", place).where(F.col("__k") <= most)
    shown = first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("__k", value))), lambda x: x[value]).alias("shown"))
    counts = df.groupBy(key).agg(F.count("*").alias("__n"))
    return counts.join(shown, key).select(key, "shown", F.greatest(F.lit(0).cast("long"), F.col("__n") - most).alias("held"))
