"""From probabilities to decisions: ensembles, offsets, safe operating point, zones, thresholds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage
from .evaluation import P, argmax
from .ordered import running


def logp(c: Column) -> Column:
    return F.log(F.least(F.lit(1.0), F.greatest(F.lit(1e-6), c)))


def shifted(b: tuple[Column, Column, Column]) -> dict[str, Column]:
    """Probabilities after offsets b on the log scale, adding up to one."""
    z = [logp(F.col(p)) + x for p, x in zip(P, b)]
    top = F.greatest(*z)
    e = [F.exp(x - top) for x in z]
    return {p: x / (e[0] + e[1] + e[2]) for p, x in zip(P, e)}


def soft_vote(df: DataFrame, keys: list[str], members: list[str]) -> DataFrame:
    """The members' mean probabilities of every sample that all of them have."""
    return df.where(F.col("model").isin(members)).groupBy(*keys).agg(*(F.avg(p).alias(p) for p in P), F.count("*").alias("m"), F.first("y").alias("y")).where(F.col("m") == len(members)).drop("m")


def _places(edges: list[float]):
    """How many of the sorted edges are no greater than a number, so the place of the first that is."""

    def place(x: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series(np.searchsorted(np.array(edges), x.to_numpy(), side="right").astype("int32"))

    return F.pandas_udf(place, "int")


def offset_f1(df: DataFrame, by: list[str], steps: int = 61, span: float = 3.0) -> DataFrame:
    """(by, b1, b2, f1) for every pair of offsets of a steps x steps grid on -span … span: macro F1 over three classes of argmax(log p + (0, b1, b2)).

    A row's decision depends on three numbers only: u = l0 - l1, v = l0 - l2, w = l1 - l2, and these on the grid only through
    the least step at which each comparison turns. Rows are counted per such cell, so the grid meets cells, not rows; these
    are at most (steps + 1) squared times 2 steps times 3 a group, whatever the data, and are shared out in parts of some 20,000.
    """
    grid = [round(-span + 2 * span * k / (steps - 1), 10) for k in range(steps)]
    l0, l1, l2 = (logp(F.col(p)) for p in P)

    # class 1 beats 0 if b1 > u; class 2 beats 0 if b2 > v; class 2 beats 1 if b2 - b1 > w (argmax takes the first of equals)
    diffs = sorted({round(a - b, 10) for a in grid for b in grid})
    turn, third = _places(grid), _places(diffs)
    cells = cut_lineage(df.groupBy(*by, turn(l0 - l1).alias("i"), turn(l0 - l2).alias("j"), third(l1 - l2).alias("k"), "y").agg(F.count("*").alias("n")))
    first, schema = [*by, "part"], ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema if f.name in by), "g int", *(f"{n}{c} bigint" for c in range(3) for n in ("tp", "s"))])

    def counted(pdf):
        """Of some cells of a group, for every pair of the grid: hits, and true plus called ones, of each class."""
        import numpy as np

        a, b = np.divmod(np.arange(steps * steps), steps)
        c = b - a + steps - 1
        out = np.zeros((steps * steps, 6), np.int64)
        for at in range(0, len(pdf), 2000):
            part = pdf.iloc[at : at + 2000]
            i, j, k, y, n = (part[x].to_numpy()[:, None] for x in ("i", "j", "k", "y", "n"))
            one, two, last = a >= i, b >= j, c >= k
            called = np.where(one & ~(two & last), 1, np.where(two & (~one | last), 2, 0))
            for x in range(3):
                is_x = called == x
                out[:, 2 * x] += ((is_x & (y == x)) * n).sum(0)
                out[:, 2 * x + 1] += (is_x * n).sum(0) + ((y == x) * n).sum()
        return pd.DataFrame({**{x: [pdf[x].iloc[0]] * len(out) for x in by}, "g": np.arange(len(out), dtype=np.int32), **{f"{m}{x}": out[:, 2 * x + z] for x in range(3) for z, m in enumerate(("tp", "s"))}})

    most = cells.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    parts = cells.withColumn("part", F.pmod(F.xxhash64("i", "j", "k"), F.lit(-(-most // 20_000) or 1))).groupBy(*first).applyInPandas(counted, schema)
    counts = parts.groupBy(*by, "g").agg(*(F.sum(f"{n}{c}").alias(f"{n}{c}") for c in range(3) for n in ("tp", "s")))
    f1 = sum(2.0 * F.col(f"tp{c}") / F.greatest(F.lit(1), F.col(f"s{c}")) for c in range(3)) / 3
    values = F.array(*map(F.lit, grid))
    return counts.select(*by, F.get(values, F.expr(f"cast(g div {steps} as int)")).alias("b1"), F.get(values, F.col("g") % steps).alias("b2"), f1.alias("f1"))


def best_offsets(grid: DataFrame, by: list[str]) -> DataFrame:
    """(by, b1, b2, f1, f1_plain): the first best pair, b1 before b2; (0, 0) unless it is strictly better."""
    best = grid.groupBy(*by).agg(F.max_by(F.struct("b1", "b2", "f1"), F.struct("f1", -F.col("b1"), -F.col("b2"))).alias("x"), F.max(F.when((F.col("b1") == 0) & (F.col("b2") == 0), F.col("f1"))).alias("f1_plain"))
    better = F.col("x.f1") > F.col("f1_plain")
    return best.select(*by, F.when(better, F.col("x.b1")).otherwise(0.0).alias("b1"), F.when(better, F.col("x.b2")).otherwise(0.0).alias("b2"), F.greatest("x.f1", "f1_plain").alias("f1"), "f1_plain")


def rank_from_top(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """(by, value, c, upto, n): distinct values from the highest, how many rows have each, and that or more."""
    rows = df.groupBy(*by, value.alias("value")).agg(F.count("*").alias("c"))
    r = running(rows, by, [F.desc("value")], {"upto": "c"})
    total = rows.groupBy(*by).agg(F.sum("c").alias("n"))
    return r.join(total, by)


def quantile(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """(by, q): the exact quantile with straight lines between neighbours, out of running counts of distinct values, so that no task holds a group."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("c"))
    r = running(rows, by, [F.asc("value")], {"upto": "c"}).join(rows.groupBy(*by).agg(F.sum("c").alias("n")), by)
    place = (F.col("n") - 1) * F.lit(q)
    low, high = F.floor(place) + 1, F.ceil(place) + 1
    ends = r.groupBy(*by).agg(F.min(F.when(F.col("upto") >= low, F.col("value"))).alias("a"), F.min(F.when(F.col("upto") >= high, F.col("value"))).alias("b"), F.first("n").alias("n"))
    return ends.select(*by, (F.col("a") + (F.col("b") - F.col("a")) * (place - F.floor(place))).alias("q"))


def safe_boost(df: DataFrame, by: list[str], recall: float = 0.95, step: float = 0.05, most: float = 8.0) -> DataFrame:
    """(by, boost): the least step multiple to add to log p_organic so that the wanted share of genuine rows is called genuine; `most` if none is enough.

    A genuine row needs max(l1, l2) - l0 or more; the share is met by an order statistic of these, rounded up to the grid.
    """
    need = F.greatest(logp(F.col(P[1])), logp(F.col(P[2]))) - logp(F.col(P[0]))
    # in whole steps, with slack for rows that lie on a step
    steps = F.greatest(F.lit(0), F.ceil((need - 1e-12) / step)).cast("int")
    counts = df.where("y = 0").groupBy(*by, steps.alias("k")).agg(F.count("*").alias("c"))  # at most a few hundred rows a group
    w = Window.partitionBy(*by).orderBy("k")
    r = counts.withColumns({"upto": F.sum("c").over(w), "n": F.sum("c").over(Window.partitionBy(*by))})
    last = round(most / step)
    return r.groupBy(*by).agg(F.min(F.when((F.col("upto") >= F.lit(recall) * F.col("n")) & (F.col("k") <= last), F.col("k"))).alias("k")).select(*by, F.coalesce(F.col("k") * F.lit(step), F.lit(most)).alias("boost"))


def zone_thresholds(val: DataFrame, by: list[str], cap: float = 0.05) -> DataFrame:
    """(by, lo, hi) on p_organic: its cap quantile of genuine rows, and the greater 1 - cap quantile of the other classes present; the midpoint for both if they cross."""
    lo = quantile(val.where("y = 0"), by, P[0], cap).withColumnRenamed("q", "lo")
    hi = quantile(val.where("y > 0"), [*by, "y"], P[0], 1 - cap).groupBy(*by).agg(F.max("q").alias("hi"))
    mid = (F.col("lo") + F.col("hi")) / 2
    crossed = F.col("hi") < F.col("lo")
    return lo.join(hi, by).select(*by, F.when(crossed, mid).otherwise(F.col("lo")).alias("lo"), F.when(crossed, mid).otherwise(F.col("hi")).alias("hi"))


def zone(lo: Column, hi: Column) -> Column:
    """0 organic at or above hi, below lo the likelier of the other classes, else -1."""
    return F.when(F.col(P[0]) >= hi, 0).when(F.col(P[0]) < lo, argmax(F.col(P[1]), F.col(P[2])) + 1).otherwise(-1)
