"""A table that a stream keeps up to date under the guard of hand-made edits.

Every micro-batch writes a new version from the one before it, so a batch that
is run again replaces its own version and changes nothing.  What a key holds is
the newest of all it was told, which doesn't depend on the order of batches:
late rows and replays give what one batch of all rows would.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class UpsertTable:
    """``key`` with other columns, ``status`` and ``overrides`` (names of columns set by hand), in versions under ``folder``.

    The row with the greatest ``time`` counts, ties to the greater values.  A
    null never replaces a value of the ``enrichment`` columns, each of which is
    as new as its own last value.  Columns in ``overrides`` and dismissed rows
    keep what they had.  Rows without a key are left out.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, time: str, enrichment: Sequence[str] = ()):
        self.spark, self.folder, self.key, self.time, self.enrichment = spark, folder.rstrip("/"), key, time, list(enrichment)

    def _path(self, version: int) -> str:
        return f"{self.folder}/v={version}"

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Finished versions, ascending; -1 is the table as it began."""
        path, files = self._files()
        if not files.exists(path):
            return []
        new = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in files.listStatus(path)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and files.exists(new(path, f"{n}/_SUCCESS")))

    def begin(self, stored: DataFrame) -> None:
        """Take ``stored`` (key, columns, status, overrides) as the first version."""
        columns = [c for c in stored.columns if c not in (self.key, "status", "overrides")]
        kinds = dict(stored.dtypes)
        row = ", ".join(f"{c}: {kinds[c]}" for c in columns if c not in self.enrichment)
        none = [F.lit(None).cast(f"struct<at: bigint, {row}>").alias("__row")]
        none += [F.lit(None).cast(f"struct<at: bigint, v: {kinds[c]}>").alias(f"__{c}") for c in self.enrichment]
        stored.select(self.key, F.struct(*columns).alias("__base"), "status", "overrides", *none).write.mode("overwrite").parquet(self._path(-1))

    def put(self, batch: DataFrame, number: int) -> None:
        """Write the version of a batch; only versions older than the one it starts from are let go."""
        before = [v for v in self.versions() if v < number]
        if not before:
            raise ValueError("begin the table first")
        stored = self.spark.read.parquet(self._path(before[-1]))
        told = [f.name for f in stored.schema["__row"].dataType.fields[1:]]
        at = F.col(self.time).cast("bigint").alias("at")
        newest = [F.max(F.struct(at, *told)).alias("__row")] + [F.max(F.when(F.col(c).isNotNull(), F.struct(at, F.col(c).alias("v")))).alias(f"__{c}") for c in self.enrichment]
        new = batch.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(*newest).select(self.key, F.struct("__row", *[f"__{c}" for c in self.enrichment]).alias("__new"))
        both = stored.join(new, self.key, "full")
        merged = [F.greatest(c, f"__new.{c}").alias(c) for c in ("__row", *[f"__{c}" for c in self.enrichment])]
        both.select(self.key, "__base", "status", "overrides", *merged).write.mode("overwrite").parquet(self._path(number))
        path, files = self._files()
        for old in before[:-1]:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._path(old)), True)

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Put what the stream has now, batch by batch."""
        return stream.writeStream.foreachBatch(self.put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def read(self) -> DataFrame:
        """The newest version, as the table is seen."""
        rows = self.spark.read.parquet(self._path(self.versions()[-1]))
        columns = rows.schema["__base"].dataType.fieldNames()
        dead = F.coalesce(F.col("status") == "dismissed", F.lit(False))

        def value(c: str):
            base = F.col(f"__base.{c}")
            now = F.coalesce(F.col(f"__{c}.v"), base) if c in self.enrichment else F.when(F.col("__row").isNotNull(), F.col(f"__row.{c}")).otherwise(base)
            kept = F.col("__base").isNotNull() & (dead | F.coalesce(F.array_contains("overrides", c), F.lit(False)))
            return F.when(kept, base).otherwise(now).alias(c)

        return rows.select(self.key, *map(value, columns), "status", F.coalesce("overrides", F.array().cast("array<string>")).alias("overrides"))
