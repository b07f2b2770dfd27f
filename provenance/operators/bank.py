"""Vectors and banks: reference means, correlation, peak to correlation energy, near duplicates. All on arrays inside the JVM."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import below, cut_lineage

#: Entries of a bank that are broadcast: 20,000 vectors of 64 doubles are some 10 MB.
BANK = 20_000


def let(c: Column, f) -> Column:
    """f(c) with c worked out once: a lambda's argument is a value, while a column named in a lambda is worked out for every element."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def centred(v: Column) -> Column:
    return let(F.transform(v, lambda x: x.cast("double")), lambda a: let(_sum(a) / F.size(a), lambda m: F.transform(a, lambda x: x - m)))


def unit(v: Column) -> Column:
    """v without its mean, of length 1 (with the small constant that keeps a flat vector at 0)."""
    return let(centred(v), lambda c: let(F.greatest(F.sqrt(dot(c, c)), F.lit(1e-12)), lambda n: F.transform(c, lambda x: x / n)))


def reference_means(refs: DataFrame, by: str, vector: str, dims: int) -> DataFrame:
    """(by, k): element-wise means, as one column per element so that sums are partially aggregated and nothing is collected."""
    sums = refs.groupBy(by).agg(*(F.avg(F.get(vector, F.lit(i)).cast("double")).alias(f"d{i}") for i in range(dims)))
    return sums.select(by, F.array(*(f"d{i}" for i in range(dims))).alias("k"))


def bank_scores(queries: DataFrame, bank: DataFrame, q: str, k: str, name: str = "ncc") -> DataFrame:
    """Every query against every bank entry: normalised correlation at zero shift.

    The result is the product of both by its meaning. The bank's vectors are made units once, then sent to all tasks if it
    has BANK entries at most (a count is taken); a larger one meets the queries partition by partition.
    """
    units = bank.withColumn("__k", unit(F.col(k))).drop(k)
    units = F.broadcast(units) if below(bank, BANK) else units
    return queries.withColumn("__q", unit(F.col(q))).drop(q).crossJoin(units).withColumn(name, dot(F.col("__q"), F.col("__k"))).drop("__q", "__k")


def circular_correlation(a: Column, b: Column, n: int) -> Column:
    """The n correlations of a with b shifted round by 0 … n - 1."""
    return let(F.struct(a.alias("a"), F.concat(b, b).alias("b")), lambda x: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: dot(x["a"], F.slice(x["b"], s + 1, F.lit(n)))))


def pce(corr: Column, n: int, radius: int = 2) -> Column:
    """Signed peak at zero shift, squared, over the mean square of the correlations more than `radius` places from it, going round."""
    peak = F.get(corr, F.lit(0))
    energy = let(F.slice(corr, radius + 2, n - 2 * radius - 1), lambda r: dot(r, r)) / F.lit(float(n - 2 * radius - 1))
    return F.signum(peak) * peak * peak / F.greatest(energy, F.lit(1e-12))


def banding(rows: int, least: float, bucket: int = 256, missed: float = 0.002) -> tuple[int, int]:
    """(bands, width): signs a band so that a bucket of unlike vectors holds about `bucket` rows, and bands so that a pair of similarity `least` shares none with the probability `missed`."""
    width = max(8, math.ceil(math.log2(max(rows, 1) / bucket)))
    agree = (1 - math.acos(least) / math.pi) ** width
    return math.ceil(math.log(missed) / math.log1p(-agree)), width


def copies(df: DataFrame, item: str, vector: str) -> DataFrame:
    """(item, first): every item with the least one of the same vector. Rows without vector are left out."""
    rows = df.where(F.col(vector).isNotNull())
    first = rows.groupBy(vector).agg(F.min(item).alias("first"))
    return rows.join(first, vector).select(item, "first")


def near_duplicates(df: DataFrame, item: str, vector: str, dims: int, least: float) -> DataFrame:
    """Pairs (a, b, similarity) with a < b of different vectors whose correlation is `least` or more, among those that share a band.

    Equal vectors are first taken as one, named by their least item (see copies), so that a vector that many rows share
    makes no pairs with itself. A band is the signs of projections on fixed random directions; their number grows with that
    of the rows, so that buckets do not. Candidates are verified exactly. Rows without vector are left out.
    """
    df = df.where(F.col(vector).isNotNull()).groupBy(vector).agg(F.min(item).alias(item))
    bands, width = banding(df.count(), least)

    def keys(vectors: pd.Series) -> pd.Series:
        import numpy as np

        planes = np.random.default_rng(11).standard_normal((bands * width, dims))
        m = np.array(vectors.tolist(), dtype=float).reshape(len(vectors), dims)
        bits = ((m @ planes.T) > 0).reshape(len(m), bands, width)
        codes = (bits * (1 << np.arange(width, dtype=np.int64))).sum(2) + (np.arange(bands, dtype=np.int64) << width)
        return pd.Series(list(codes.astype("int64")))

    band = F.pandas_udf(keys, "array<bigint>")
    u = df.select(F.col(item).alias("i"), unit(F.col(vector)).alias("u"))
    k = u.select("i", "u", F.explode(band("u")).alias("key"))
    pairs = k.alias("x").join(k.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.i") < F.col("y.i"))).select(F.col("x.i").alias("a"), F.col("y.i").alias("b"), dot(F.col("x.u"), F.col("y.u")).alias("similarity"))
    return pairs.where(F.col("similarity") >= least).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(item, group): each item of a pair with the least item that it is tied to, by passing on the least label until none changes, from checkpoint to checkpoint."""
    e = pairs.select(F.col(a).alias("x"), F.col(b).alias("y"))
    e = cut_lineage(e.union(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut_lineage(e.groupBy("x").agg(F.least("x", F.min("y")).alias("label")))
    while True:
        heard = e.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("label").alias("heard"))
        after = cut_lineage(labels.join(heard, "x").select("x", F.least("label", "heard").alias("label"), (F.col("heard") < F.col("label")).alias("moved")))
        labels = after.drop("moved")
        if not after.where("moved").limit(1).count():
            return labels.select(F.col("x").alias("item"), F.col("label").alias("group"))
