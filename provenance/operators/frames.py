"""Features of frame sequences: windows of first frames, lags, prefixes, padding, picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_frames(df: DataFrame, clip: str, order: list[str]) -> DataFrame:
    return df.withColumn("frame", F.row_number().over(Window.partitionBy(clip).orderBy(*order)) - 1)


def slog(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def window_features(frames: DataFrame, clip: str, values: list[str], window: int, prefix: str = "") -> DataFrame:
    """(clip, <v>_mean, <v>_std, <v>_min, n_frames) over a clip's first `window` frames; std of one frame is null, NaN counts as missing."""
    first = frames.where(F.col("frame") < window)
    aggs = [F.count("*").alias(f"{prefix}n_frames")]
    for v in values:
        x = F.nanvl(v, F.lit(None).cast("double"))
        aggs += [F.avg(x).alias(f"{prefix}{v}_mean"), F.stddev_samp(x).alias(f"{prefix}{v}_std"), F.min(x).alias(f"{prefix}{v}_min")]
    return first.groupBy(clip).agg(*aggs)


def slog_columns(df: DataFrame, part: str) -> DataFrame:
    """The signed log of every double column whose name holds `part`."""
    return df.withColumns({c: slog(F.col(c)) for c, t in df.dtypes if t == "double" and part in c})


def lagged(frames: DataFrame, clip: str, value: str) -> DataFrame:
    """frames with prev, the value of the frame before, null for the first."""
    return frames.withColumn("prev", F.lag(value).over(Window.partitionBy(clip).orderBy("frame")))


def prefix_sums(frames: DataFrame, clip: str, value: str, at: list[int]) -> DataFrame:
    """(clip, sum_<w>) over the first w frames, for each w: a conditional sum each, so no order is needed."""
    return frames.groupBy(clip).agg(*(F.sum(F.when(F.col("frame") < w, F.col(value))).alias(f"sum_{w}") for w in at))


def padded(frames: DataFrame, clip: str, value: str, window: int) -> DataFrame:
    """(clip, n, xs): the first `window` values in order, repeated from the start where the clip is shorter. A clip holds `window` entries at most."""
    seq = frames.where(F.col("frame") < window).groupBy(clip).agg(F.sort_array(F.collect_list(F.struct(F.col("frame").alias("k"), F.col(value).alias("v")))).alias("s"))
    n = F.size("s")
    return seq.select(clip, n.alias("n"), F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda i: F.get("s", i % n)["v"]).alias("xs"))


def even_picks(n: Column, k: int) -> Column:
    """k places spread evenly over 0 … n - 1, cut down to whole numbers, without repeats; one place is the first."""
    if k == 1:
        return F.array(F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / F.lit(float(k - 1))).cast("int")))


def stride(n: Column, most: int) -> Column:
    """The step that leaves about `most` of n frames, one at least."""
    return F.greatest(F.lit(1), F.floor(n / most)).cast("int")
