"""Reading the test tables, and writing intermediate tables to the shared folder of the cluster."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table; columns are pruned and filters pushed down by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only where it is unset, as in tests, a folder of this machine is taken."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="provenance-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later plans start from files that outlive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a table in the shared folder, computed once. Unlike a checkpoint it is columnar, so later reads are pruned. Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended; the folder is the cluster's to clear
            return


def below(df: DataFrame, most: int) -> bool:
    """Whether df has at most that many rows: the check before a broadcast."""
    return df.select(F.lit(1)).limit(most + 1).count() <= most
