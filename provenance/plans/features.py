"""Queries of signal kernels. No table holds planes, so an embedding of 64 numbers stands for a plane of 8 x 8."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kernels as K
from ..sources.tables import table
from ..streaming import ingest


def _planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = F.udf(lambda v: struct.pack(f"{len(v)}f", *v) if v is not None and len(v) == 64 else None, "binary", useArrow=True)
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.lit(0).alias("frame"), F.lit(8).alias("h"), F.lit(8).alias("w"), pack("embedding").alias("y")).where("y is not null")


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.frame_features(_planes(spark, sf_dir), "vec_id")


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.fingerprints(_planes(spark, sf_dir), "label").select("label", "h", "w", "n", F.length("k").alias("bytes"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _planes(spark, sf_dir)
    return K.plane_scores(p.select("vec_id", "h", "w", F.col("y").alias("k")), K.fingerprints(p, "label").withColumnRenamed("label", "candidate"), "vec_id", "candidate")


def arrivals_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events per day and type, counted by a stream over the table's file and read when it has ended."""
    import os
    import tempfile

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table(spark, sf_dir, "events").schema)
    folder = tempfile.mkdtemp() if "://" not in sf_dir else sf_dir
    if folder != sf_dir:
        os.symlink(f"{sf_dir}/events.parquet", f"{folder}/events.parquet")
    name = f"days_{os.urandom(4).hex()}"
    counted = ingest.per_day(ingest.arrivals(spark, folder, schema), "ts", "1 day", "event_type")
    counted.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.date_format("day.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES = {"fft_stats": spectrum, "fingerprint_planes": patterns, "plane_scores": scores, "stream_days": arrivals_per_day}
SQL = {"stream_days": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL"}
