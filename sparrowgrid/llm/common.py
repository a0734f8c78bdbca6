"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import SparkSession

from sparrowgrid.operators.graph import components
from sparrowgrid.operators.tables import drop, release, shared_dir, written

__all__ = ["bounded", "components", "drop", "release", "settle", "shared_dir", "written"]

#: Text bytes that one Arrow slice hands to a Python helper at a time.
SLICE_BYTES = 4 << 20


def settle(spark: SparkSession) -> None:
    """What the operators ask of a session: small Arrow batches, and workers that find this package in local mode.

    On a cluster the package is shipped as usual (--py-files) and the path does no harm.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def bounded(batches, column: str, limit: int = SLICE_BYTES):
    """Slices of the batches in which ``column`` holds about ``limit`` bytes at most (one row at least)."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        sizes = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)
