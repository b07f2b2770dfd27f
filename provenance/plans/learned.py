"""Queries of learned models over predictions, scores and embeddings. No SQL says them; tests hold them to accuracy on held-out rows."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models as M
from ..sources.tables import table
from .evaluation import scored
from .signals import fusion_features, pairs

MEMBERS = ["svm", "xgb"]
KEYS = ["split_name", "part", "sample_id"]


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.wide(scored(spark, sf_dir), KEYS, MEMBERS)


def stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression on the members' log-probabilities, fit on validation rows of all splits, for the other rows."""
    w = _wide(spark, sf_dir)
    model = M.stacked(w.where("part = 'val'"), M.features(MEMBERS))
    return M.predicted(model, w.where("part <> 'val'"), KEYS)


def rel_stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a reliability indicator of each sample (the best PCE of its clip, where scored) and its products."""
    best = pairs(spark, sf_dir).groupBy("query").agg(F.max("pce0").alias("rel"))
    w = _wide(spark, sf_dir).join(best, F.col("sample_id") == F.col("query"), "left").drop("query")
    if not w.where("part = 'val' and rel is not null").limit(1).count():
        w = w.withColumn("rel", F.col("x0_0") - F.col("x1_0"))  # no clip of the validation rows was scored: how far the members differ
    val = w.where("part = 'val'")
    out, names = M.reliability_design(w, M.features(MEMBERS), ["rel"], val)
    model = M.stacked(out.where("part = 'val'"), names, 0.1, True)
    return M.predicted(model, out.where("part <> 'val'"), KEYS)


def imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "videos")
    xs = ["fps", "duration_s", "bitrate_kbps", "size_mb"]
    return M.impute_scale(v.where("split = 'train'").select(*xs), v.select("row_id", *xs), xs)


def camera_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every pair of (query, candidate), how likely it is a match: regression on signed-log pce0, ncc and whether it is the first; fit on training queries."""
    f = fusion_features(spark, sf_dir).join(pairs(spark, sf_dir).select("query", "candidate", "ncc", "split", "is_match"), ["query", "candidate"])
    rows = VectorAssembler(inputCols=["slog_pce0", "ncc", "top"], outputCol="features", handleInvalid="skip").transform(f.withColumn("top", F.col("is_top").cast("double")).withColumn("label", F.col("is_match").cast("double")))
    model = LogisticRegression(maxIter=100, regParam=1e-4).fit(rows.where("split = 'train'"))
    return model.transform(rows).select("query", "candidate", "is_match", F.get(vector_to_array("probability"), F.lit(1)).alias("p"))


def linear_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of every vector by regression on it, fit on four fifths by a hash of the id."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null")
    rows = e.select("vec_id", "label", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"), (F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0).alias("held_out"))
    model = LogisticRegression(maxIter=100, regParam=1e-3).fit(rows.where("not held_out").withColumn("label", F.col("label").cast("double")))
    return model.transform(rows.withColumn("label", F.col("label").cast("double"))).select("vec_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"), "held_out")


def camera_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.group_folds(scored(spark, sf_dir).where("part = 'val' and claimed_device is not null").select("claimed_device"), "claimed_device", 3)


QUERIES = {"stacking_lr": stacking, "rel_stacking_lr": rel_stacking, "impute_scale": imputed, "camera_fusion_lr": camera_fusion, "linear_probe": linear_probe, "group_kfold": camera_folds}
