"""Ledgers read as streams: the latest row of each key, counts of windows, first deliveries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder


def run_to_end(stream: DataFrame, mode: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there, and return its result as a table.

    In append mode each batch is written as files. In update mode a batch holds only the rows that it changed; when the table
    is read, the row of each of *keys* from the latest batch counts. In complete mode each batch holds everything, and
    the last one counts; that is for small results. Checkpoints and output lie in the shared folder, so a run goes on after a
    failure where it stopped.
    """
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/fathomry-stream-{uuid.uuid4().hex}/{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    job = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    job.awaitTermination()
    schema = stream.schema.add("_batch", "integer")
    found = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/out")
    if mode == "complete":
        last = found.agg(F.max("_batch")).first()[0]
        found = found.where(F.col("_batch") == F.lit(last if last is not None else -1))
    if mode == "update":
        others = [c for c in found.columns if c not in keys]
        latest = found.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("_row"))
        found = latest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])
    return found


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """A table's files as a stream, a few at a time."""
    schema = spark.read.parquet(path).schema
    root, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(path) if not _is_file(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_batch).parquet(root)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def latest_rows(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row by *order* of each key so far: state holds one row for each key."""
    others = [c for c in stream.columns if c != key]
    best = stream.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in others])


def window_counts(stream: DataFrame, time: str, size: str, late: str, *keys: Column) -> DataFrame:
    """The rows of each window of *time* and key; rows later than the watermark *late* are left out, finished windows emitted."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    counted = stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), *keys).agg(F.count("*").alias("rows"))
    return counted.select(F.col("w.start").alias("begins"), *[c for c in counted.columns if c not in ("w", "rows")], "rows")


def first_deliveries(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The rows without those delivered again within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
