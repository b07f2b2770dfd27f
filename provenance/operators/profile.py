"""Column profiles per group of rows, and how they differ between groups (problem 4).

Counts per (group, column, value) are the one thing taken from the table. They merge by addition, and everything else
follows from them: nulls, distinct values, ranges, violations, and the power sums of numbers, which are exact since
numbers are counted in whole units of a stated size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXACT = "decimal(38,0)"
#: Names of the results, which the group column cannot have.
CLASHES = {"x", "column_name", "value", "is_bad", "bucket", "unit", "n"}


@dataclass(frozen=True)
class Rule:
    """How a column is read. bad: which non-null values are violations (never null). digits: decimals kept in the power
    sums of a number. bucket: what is compared between groups, the value itself if none."""

    bad: Callable[[Column], Column] | None = None
    digits: int = 3
    bucket: Callable[[Column], Column] | None = None


def matches(pattern: str) -> Rule:
    """A rule by a regular expression that values must match in full."""
    return Rule(lambda c: ~c.rlike(rf"\A(?:{pattern})\z"))


def _cell(df: DataFrame, name: str, rule: Rule) -> Column:
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    bad = F.coalesce(rule.bad(c), F.lit(False)) if rule.bad else F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.lit(False)
    good = c.isNotNull() & ~F.coalesce(bad, F.lit(False))
    unit = F.lit(None).cast(EXACT)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        unit = F.when(good & (F.abs(c) < 1e18), F.rint(c * F.lit(10.0**rule.digits)).cast(EXACT))
    elif isinstance(kind, T.IntegralType):
        unit = F.when(good, c.cast(EXACT))
    nested = isinstance(kind, (T.ArrayType, T.StructType, T.MapType))
    shown = F.when(c.isNotNull(), F.to_json(F.struct(c))) if nested else c.cast("string")
    bucket = shown if nested else (rule.bucket(c) if rule.bucket else c).cast("string")
    return F.struct(
        F.lit(name).alias("column_name"), shown.alias("value"), F.coalesce(bad & c.isNotNull(), F.lit(False)).alias("is_bad"),
        F.when(good, bucket).alias("bucket"),
        unit.alias("unit"),
    )


def value_counts(df: DataFrame, by: str, rules: dict[str, Rule]) -> DataFrame:
    """(by, column_name, value, is_bad, bucket, unit, n): the mergeable state. Rows of the null group are left out.

    A task adds up its own rows first, so a group that holds most rows is no hot key; then rows spread by value.
    """
    if by in CLASHES or by in rules:
        raise ValueError(f"the group column must not be named {by}, nor be profiled")
    cells = F.array(*(_cell(df, name, rule) for name, rule in rules.items()))
    return df.where(F.col(by).isNotNull()).select(by, F.explode(cells).alias("x")).groupBy(by, "x.column_name", "x.value", "x.is_bad", "x.bucket", "x.unit").agg(F.count("*").alias("n"))


def profile(counts: DataFrame, by: str, digits: dict[str, int] | None = None) -> DataFrame:
    """One row per group and column: rows, nulls, bads, goods, n_distinct, least, most, power sums s1 to s4 of the good numbers.

    least and most are of the good values, numbers in units of 10**-digits, texts in byte order. A power sum that leaves 38 digits is null.
    """
    n = F.col("n").cast(EXACT)
    unit, bucket = F.col("unit"), F.col("bucket")

    def power(k: int) -> Column:
        x = n
        for _ in range(k):
            x = F.try_multiply(x, unit).cast(EXACT)
        return F.try_sum(x).alias(f"s{k}")

    return counts.groupBy(by, "column_name").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        F.sum(F.when(F.col("is_bad"), F.col("n")).otherwise(0)).alias("bads"),
        F.sum(F.when(bucket.isNotNull(), F.col("n")).otherwise(0)).alias("goods"),
        F.count("value").alias("n_distinct"),
        F.min(F.when(unit.isNull() & bucket.isNotNull(), F.col("value"))).alias("least_text"),
        F.max(F.when(unit.isNull() & bucket.isNotNull(), F.col("value"))).alias("most_text"),
        F.min("unit").alias("least"),
        F.max("unit").alias("most"),
        F.sum(F.when(unit.isNotNull(), F.col("n"))).alias("numbers"),
        *(power(k) for k in (1, 2, 3, 4)),
    )


def moments(profiled: DataFrame, digits: dict[str, int]) -> DataFrame:
    """mean, sd (of the population), skewness and kurtosis (excess) out of the power sums, in the units of the column."""
    size = F.coalesce(F.create_map(*(F.lit(x) for k, v in digits.items() for x in (k, 10.0**v)))[F.col("column_name")], F.lit(1.0)) if digits else F.lit(1.0)
    m = F.col("numbers").cast(EXACT)
    # n*S2 - S1*S1 is whole and so loses nothing; only the last step is a double
    wide = F.try_subtract(F.try_multiply(m, F.col("s2")).cast(EXACT), F.try_multiply(F.col("s1"), F.col("s1")).cast(EXACT))
    n = F.col("numbers").cast("double")
    mean, sd = F.col("s1").cast("double") / n, F.sqrt(wide.cast("double")) / n
    third = F.col("s3").cast("double") / n - 3 * mean * F.col("s2").cast("double") / n + 2 * mean * mean * mean
    fourth = F.col("s4").cast("double") / n - 4 * mean * F.col("s3").cast("double") / n + 6 * mean * mean * F.col("s2").cast("double") / n - 3 * mean * mean * mean * mean
    return profiled.select(
        "*", (mean / size).alias("mean"), (sd / size).alias("sd"),
        F.when(sd > 0, third / (sd * sd * sd)).alias("skewness"), F.when(sd > 0, fourth / (sd * sd * sd * sd) - 3).alias("kurtosis"),
    )


def with_base(profiled: DataFrame, bases: DataFrame, by: str, columns: Iterable[str]) -> DataFrame:
    """Each profile beside that of the group it is compared with; bases: (by, base). Pairs without rows on either side fall away."""
    base = profiled.select(F.col(by).alias("base"), "column_name", *(F.col(c).alias(f"base_{c}") for c in columns))
    return profiled.join(bases, by).join(base, ["base", "column_name"])


def shifts(pairs: DataFrame) -> DataFrame:
    """The standardised difference of means, and the log ratio of spreads, of profiles with moments and a base."""
    pooled = F.sqrt((F.col("sd") * F.col("sd") + F.col("base_sd") * F.col("base_sd")) / 2)
    return pairs.withColumns({
        "d_mean": F.when(pooled > 0, (F.col("mean") - F.col("base_mean")) / pooled).when(F.col("mean") == F.col("base_mean"), 0.0),
        "log_sd_ratio": F.when((F.col("sd") > 0) & (F.col("base_sd") > 0), F.log(F.col("sd") / F.col("base_sd"))),
    })


def times(a: str, b: str) -> Column:
    return F.col(a).cast("decimal(18,0)") * F.col(b).cast("decimal(18,0)")


def mix_distance(counts: DataFrame, pairs: DataFrame, by: str) -> DataFrame:
    """pairs with differ: the sum over all buckets of |n * base_goods - base_n * goods|, whole numbers. Twice goods * base_goods is the most."""
    keys = [by, "base", "column_name", "goods", "base_goods"]
    both = pairs.select(*keys).where("goods > 0 and base_goods > 0")
    good = counts.where("bucket is not null").groupBy(by, "column_name", "bucket").agg(F.sum("n").alias("n"))
    own = both.join(good, [by, "column_name"]).select(*keys, "bucket", "n", F.lit(0).cast("long").alias("base_n"))
    other = both.join(good.withColumnRenamed(by, "base"), ["base", "column_name"]).select(*keys, "bucket", F.lit(0).cast("long").alias("n"), F.col("n").alias("base_n"))
    return (
        own.unionByName(other)
        .groupBy(*keys, "bucket")
        .agg(F.sum("n").alias("n"), F.sum("base_n").alias("base_n"))
        .groupBy(*keys)
        .agg(F.sum(F.abs(times("n", "base_goods") - times("base_n", "goods"))).alias("differ"))
    )
