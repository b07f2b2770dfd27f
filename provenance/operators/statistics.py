"""Resampling and tests: cluster bootstrap out of per-cluster sums, McNemar, fold statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Clusters (cameras) that the bootstrap holds as one array; more are an error, not a cut.
CLUSTERS = 20_000


def draw(b: Column, slot: Column, n: Column) -> Column:
    """A uniform place of 0 … n - 1, by a hash of the resample and the slot: the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(b.cast("string"), F.lit(":"), slot.cast("string"))), 1, 7), 16, 10).cast("bigint") % n


def cluster_sums(df: DataFrame, cluster: str, sums: dict[str, Column]) -> DataFrame:
    """(cluster, sums …): all that a resample needs to know of a cluster."""
    return df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(*(F.sum(c.cast("bigint")).alias(n) for n, c in sums.items()))


def resampled(per: DataFrame, cluster: str, sums: list[str], resamples: int) -> DataFrame:
    """(resample, sums …) of so many resamples, each of as many clusters, drawn with repeats, as there are.

    Resamples times clusters numbers are drawn, in parallel by resample; the rows behind the clusters are never read again.
    """
    n = per.count()
    if n > CLUSTERS:
        raise ValueError(f"more than {CLUSTERS} clusters")
    spark = per.sparkSession
    table = per.groupBy().agg(F.sort_array(F.collect_list(F.struct(cluster, *sums))).alias("t"))  # n entries
    draws = spark.range(0, resamples, 1, min(resamples, 64)).select(F.col("id").alias("resample"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("slot"))
    hit = draws.join(F.broadcast(table)).select("resample", F.get("t", draw(F.col("resample"), F.col("slot"), F.lit(max(n, 1))).cast("int")).alias("x"))
    return hit.groupBy("resample").agg(*(F.sum(f"x.{s}").alias(s) for s in sums))


def interval(df: DataFrame, by: list[str], value: str) -> list[Column]:
    """Exact 2.5 and 97.5 % points; df holds one row per resample."""
    return [F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.975).alias("high")]


def two_sided(diff: Column, resamples: int) -> Column:
    """The p-value of a difference: twice the smaller share at or beyond 0, from 1 / resamples to 1."""
    below, above = F.avg((diff <= 0).cast("double")), F.avg((diff >= 0).cast("double"))
    return F.least(F.lit(1.0), F.greatest(F.lit(1.0 / resamples), 2 * F.least(below, above)))


def mcnemar(b: int, c: int) -> float:
    """The exact two-sided p-value of b against c discordant pairs."""
    n = b + c
    if not n:
        return 1.0
    log_half = n * math.log(0.5)
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + log_half) for k in range(min(b, c) + 1))
    return min(1.0, 2 * tail)
