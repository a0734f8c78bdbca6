"""Scores of records by a pluggable scorer that sees batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Takes a batch's columns and gives a score from 0 to 100 for each row; null where it has none.
Scorer = Callable[[pd.DataFrame], pd.Series]


def length_scorer(column: str) -> Scorer:
    """A deterministic stand-in for a model: the rest of the column's value by 101."""
    return lambda batch: batch[column] % 101


def scored(df: DataFrame, scorer: Scorer, columns: Sequence[str], name: str = "score") -> DataFrame:
    """``df`` with the scorer's score; scores outside 0 to 100 are an error of the scorer and become null, as do those of rows it fails on."""
    keep = [c for c in df.columns if c != name]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                found = scorer(batch[list(columns)])
            except ValueError:  # the batch holds a row that the scorer can't take: row by row
                found = pd.Series([_one(scorer, batch[list(columns)].iloc[[i]]) for i in range(len(batch))], index=batch.index)
            found = pd.to_numeric(found, errors="coerce")
            yield batch.assign(**{name: found.where(found.between(0, 100)).astype("Int64")})

    return df.select(*keep).mapInPandas(run, schema)


def _one(scorer: Scorer, row: pd.DataFrame):
    try:
        return scorer(row).iloc[0]
    except ValueError:
        return None


def tier(c: str | Column, high: int = 70, medium: int = 40) -> Column:
    score = F.col(c) if isinstance(c, str) else c
    return F.when(score >= high, "high").when(score >= medium, "medium").when(score.isNotNull(), "low")
