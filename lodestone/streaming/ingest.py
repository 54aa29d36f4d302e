"""Ingest of files as a stream: first of each fingerprint, and counts by window of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files_as_stream(spark: SparkSession, path: str, schema: str, files_each: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream, so many in each batch; a file counts once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def run_to_end(stream: DataFrame, checkpoint: str, each) -> None:
    """Take all files that are there in batches, then stop; each(batch, number) must be repeatable, as a batch may come twice."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_first(spark: SparkSession, path: str, schema: str, target: str, key: str) -> None:
    """Append the rows of new files whose key isn't in the target yet; a batch is a folder of its own, replaced if it comes again.

    The target is the only state, so it survives any restart; a batch's keys are joined with it.
    """

    def each(batch: DataFrame, number: int) -> None:
        first = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*[c for c in batch.columns if c != key])).alias("r")).select(key, "r.*")
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/rows")
        if number and p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            seen = spark.read.parquet(f"{target}/rows").filter(F.col("batch") < number)
            first = first.join(seen.select(key), key, "left_anti")
        first.write.mode("overwrite").parquet(f"{target}/rows/batch={number}")

    run_to_end(files_as_stream(spark, path, schema), f"{target}/checkpoint", each)


def windowed_counts(spark: SparkSession, path: str, schema: str, target: str, ts: str, by: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, by, n) of tumbling windows over a stream of files, late rows up to the watermark counted."""
    x = files_as_stream(spark, path, schema).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    counts = x.groupBy(F.window(ts, width), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/counts")  # all windows, each time

    counts.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{target}/counts")
