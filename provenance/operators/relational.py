"""Relational building blocks that recur: de-duplication, first rows of a group, schema pins, joins by set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep(df: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """One row per key, the first (or last) by `order`, which must be unique per key. An aggregation with partial results, not a window, so a key of many copies is no hot one."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), F.col(order))
    return df.groupBy(*keys).agg(pick.alias("__r")).select(*keys, "__r.*").select(*df.columns)


def merge_runs(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by name, a key's new row before its old one; columns that one side lacks are null there."""
    both = old.withColumn("__run", F.lit(0)).unionByName(new.withColumn("__run", F.lit(1)), allowMissingColumns=True)
    return keep(both, keys, "__run", last=True).drop("__run")


def replace_part(old: DataFrame, new: DataFrame, part: str) -> DataFrame:
    """old without the parts that new holds, and new."""
    return old.join(new.select(part).distinct(), part, "left_anti").unionByName(new)


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "n") -> DataFrame:
    """Places from 0 in each group by a total order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def pinned(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exactly these columns and types: missing ones null, others dropped."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()))


def seeded_sample(df: DataFrame, by: list[str], key: str, seed: int, n: int) -> DataFrame:
    """n rows a group by the order of a hash of seed and key: the same rows on every run and any partitioning."""
    return numbered(df, by, [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)], "__n").where(F.col("__n") < n).drop("__n")


def greedy_deal(groups: DataFrame, stratum: str, group: str, weight: str, shares: dict[str, float], seed: int) -> DataFrame:
    """groups with bin: in every stratum, in hashed order, each group goes to the bin that lacks most of its share of the weight so far, itself included; of equals to that of the smaller share, then the first by name.

    Sequential by nature, so a stratum is one task; strata are as many as kinds of cameras, groups as many as models.
    """
    import pandas as pd

    order = sorted(shares, key=lambda b: (shares[b], b))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__k", group], kind="stable")
        have, total, bins = dict.fromkeys(order, 0.0), 0.0, []
        for w in pdf[weight]:
            w = 0.0 if pd.isna(w) else float(w)
            total += w
            best = max(order, key=lambda b: shares[b] * total - have[b])
            have[best] += w
            bins.append(best)
        return pdf.assign(bin=bins).drop(columns="__k")

    keyed = groups.withColumn("__k", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group))))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in groups.schema) + ", bin string"
    return keyed.groupBy(stratum).applyInPandas(deal, schema)
