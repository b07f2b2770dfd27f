"""Sample weights: by class, by dataset, and matched to processing conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def condition(source: Column, variant: Column, social: Column, sources: list[str], crf: int) -> Column:
    """dataset|crfQ|platform of re-encoded and attacked rows, null for others."""
    base = F.split(variant, r"\+")[0]
    q = F.coalesce(F.nullif(F.regexp_extract(base, r"crf(\d+)", 1), F.lit("")), F.lit(str(crf)))
    return F.when(source.isin(sources), F.concat(F.split(source, "-")[0], F.lit("|crf"), q, F.lit("|"), social))


def _join(df: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """Null keys meet each other; the sums hold a row per key, so Catalyst may broadcast them below its threshold."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return df.alias("a").join(sums.alias("b"), on).select("a.*", *(f"b.{c}" for c in sums.columns if c not in keys))


def class_balanced(df: DataFrame, y: str) -> DataFrame:
    """df with weight n / (classes * n of the class): each class sums to the same, the mean is 1. Sums come from one small aggregate, not a window over all rows."""
    per = df.groupBy(y).agg(F.count("*").alias("__c"))
    total = per.agg(F.sum("__c").alias("__n"), F.count("*").alias("__k"))
    return _join(df, per.join(F.broadcast(total)), [y]).withColumn("weight", F.col("__n") / (F.col("__k") * F.col("__c"))).drop("__c", "__n", "__k")


def dataset_balanced(df: DataFrame, y: str, dataset: str) -> DataFrame:
    """df with weight N / (classes * datasets of the class * rows of class and dataset)."""
    per = df.groupBy(y, dataset).agg(F.count("*").alias("__c"))
    per_y = per.groupBy(y).agg(F.count("*").alias("__s"))
    total = per.agg(F.sum("__c").alias("__n"), F.count_distinct(y).alias("__k"))
    sums = _join(per, per_y, [y]).join(F.broadcast(total))
    return _join(df, sums, [y, dataset]).withColumn("weight", F.col("__n") / (F.col("__k") * F.col("__s") * F.col("__c"))).drop("__c", "__s", "__n", "__k")


def matched(df: DataFrame, y: str, cond: str, genuine: int = 0, attack: int = 1) -> DataFrame:
    """df with raw (attacks per genuine row of its condition for genuine rows where both are, else 1) and weight (raw, then each class one share of the total, mean 1)."""
    per = df.where(F.col(cond).isNotNull()).groupBy(cond).agg(F.count_if(F.col(y) == genuine).alias("__g"), F.count_if(F.col(y) == attack).alias("__a"))
    r = df.alias("a").join(per.alias("b"), F.col(f"a.{cond}") == F.col(f"b.{cond}"), "left").select("a.*", "__g", "__a")
    r = r.withColumn("raw", F.when((F.col(y) == genuine) & (F.col("__g") > 0) & (F.col("__a") > 0), F.col("__a") / F.col("__g")).otherwise(1.0)).drop("__g", "__a")
    sums = r.groupBy(y).agg(F.sum("raw").alias("__s"), F.count("*").alias("__m"))
    total = sums.agg(F.sum("__m").alias("__n"), F.count("*").alias("__k"))
    return _join(r, sums.drop("__m").join(F.broadcast(total)), [y]).withColumn("weight", F.col("raw") / (F.col("__k") * F.col("__s")) * F.col("__n")).drop("__s", "__n", "__k")


def attack_share(df: DataFrame, y: str, cond: str, weight: str, attack: int = 1) -> DataFrame:
    """(cond, share): the weighted share of attacks in each condition that has any."""
    a = F.sum(F.when(F.col(y) == attack, F.col(weight)).otherwise(0.0))
    return df.where(F.col(cond).isNotNull()).groupBy(cond).agg(F.count_if(F.col(y) == attack).alias("__a"), (a / F.sum(weight)).alias("share")).where("__a > 0").drop("__a")


def repeated(df: DataFrame, weight: str) -> DataFrame:
    """Every row as often as its weight says, rounded half to even, once at least."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.bround(weight).cast("int")))))


def calibrated(queries: DataFrame, pool: DataFrame, key: str, content: str, values: list[str], n: int, seed: int = 0) -> DataFrame:
    """queries with cal_<value>: the median of value over the first n pool rows, in hashed order, of the same key and another content; null without any.

    Only the n + (copies of one content) first rows of a key can matter; as a content may have several, each key's pool is
    cut to its first n contents plus one, hashed order going by content, before the join. So no key multiplies a query by
    more than the rows of n + 1 contents.
    """
    from pyspark.sql import Window

    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(content)))
    one = pool.where(F.col(key).isNotNull() & F.col(content).isNotNull()).groupBy(key, content).agg(*(F.avg(v).alias(v) for v in values))
    ranked = one.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(h, content))).where(F.col("__r") <= n + 1)
    lists = ranked.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__r", content, *values))).alias("__pool"))  # n + 1 entries at most
    joined = queries.join(lists, key, "left")
    own = F.slice(F.filter("__pool", lambda x: ~x[content].eqNullSafe(F.col(content))), 1, n)
    out = joined.withColumn("__own", own)
    for v in values:
        xs = F.array_sort(F.filter(F.transform("__own", lambda x: x[v]), lambda x: x.isNotNull()))
        m = F.size(xs)
        low, high = F.get(xs, F.floor((m - 1) / 2).cast("int")), F.get(xs, F.floor(m / 2).cast("int"))
        out = out.withColumn(f"cal_{v}", F.when(m > 0, (low + high) / 2))
    return out.drop("__pool", "__own")
