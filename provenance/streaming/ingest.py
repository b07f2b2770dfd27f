"""Incremental ingest of new probes by Structured Streaming: beyond what the batch operators need, with the same functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arrivals(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New parquet files of a folder as a stream; timestamps without zone become timestamps, as watermarks need them."""
    df = spark.readStream.schema(schema).parquet(path)
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.simpleString() == "timestamp_ntz"})


def per_day(stream: DataFrame, at: str, late: str, *by: str) -> DataFrame:
    """Rows per day of `at` and `by`; rows later than the watermark are dropped by it, and state is kept no longer."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("day"), *by).agg(F.count("*").alias("n"))


def first_deliveries(stream: DataFrame, at: str, late: str, keys: list[str]) -> DataFrame:
    """Each key once, within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def ingest(stream: DataFrame, keys: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Appends rows whose keys the target does not hold yet, batch by batch, each batch once."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        at = spark._jvm.org.apache.hadoop.fs.Path(target)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            new = new.join(spark.read.parquet(target).select(*keys), keys, "left_anti")
        new.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
