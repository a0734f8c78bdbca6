"""Writers: CSV documents, JSON backups that are counted, plain text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_document(df: DataFrame, path: str) -> None:
    """Quoted where needed, quotes doubled, empty text empty, lines ended by a carriage return and a line feed; one file a partition."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    quoted = [F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in columns]
    head = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in '",\r\n') else c for c in df.columns)
    lines = df.select(F.concat_ws(",", *quoted).alias("value"))
    # a header a file, so that each is a document of its own
    lines.mapInPandas(lambda batches: _headed(batches, head), "value string").write.option("lineSep", "\r\n").text(path)


def _headed(batches, head: str):
    first = True
    for batch in batches:
        if first and len(batch):
            batch = pd.concat([pd.DataFrame({"value": [head]}), batch], ignore_index=True)
            first = False
        yield batch


def sheet(df: DataFrame, group: str) -> DataFrame:
    """(row, kind, cells): a sheet's rows as text: a header, each group's heading with its count and its rows, and a summary with all counts."""
    columns = [c for c in filled_columns(df) if c != group]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(text(group).alias("g"), F.lit("2 row").alias("kind"), F.array(*[text(c) for c in columns]).alias("cells"))
    counts = df.groupBy(text(group).alias("g")).agg(F.count("*").alias("n"))
    heads = counts.select("g", F.lit("1 group").alias("kind"), F.array("g", F.col("n").cast("string")).alias("cells"))
    top = df.sparkSession.range(1).select(F.lit(None).cast("string").alias("g"), F.lit("0 header").alias("kind"), F.array(*map(F.lit, columns)).alias("cells"))
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("groups")).select(F.lit("\uffff").alias("g"), F.lit("3 summary").alias("kind"), F.array(F.col("n").cast("string"), F.col("groups").cast("string")).alias("cells"))
    return top.unionByName(heads).unionByName(rows).unionByName(total).orderBy(F.asc_nulls_first("g"), "kind", "cells").select("kind", "cells")


def backup(df: DataFrame, path: str) -> int:
    """Write JSON lines and read them again; an error if a row is missing."""
    df.write.json(path)
    wrote, there = df.sparkSession.read.schema(df.schema).json(path).count(), df.count()
    if wrote != there:
        raise ValueError(f"the backup holds {wrote} of {there} rows")
    return wrote


def restore(spark: SparkSession, path: str, schema, stored: DataFrame, key: str) -> DataFrame:
    """The stored version with the backup's rows over it."""
    rows = spark.read.schema(schema).json(path)
    return stored.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def filled_columns(df: DataFrame) -> list[str]:
    """Columns in which some row has text: a sheet leaves the others out."""
    flags = df.agg(*[F.bool_or(F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if flags[c]]


def plain_text(df: DataFrame, section: str, line: str, order: str) -> DataFrame:
    """(section, text): each section's lines in order."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(order, line))), lambda x: x[line])
    return df.groupBy(section).agg(F.array_join(lines, "\n").alias("text"))
