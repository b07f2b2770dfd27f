"""Score cutoffs that keep a target fraction of every group (problem 1): sketch-bracketed exact selection.

A quantile sketch with a guaranteed rank error (Greenwald-Khanna, Spark's percentile_approx) gives for each group two
scores between which the cutoff must lie. The records above the bracket are counted; only those inside are sorted.
While a bracket holds more records than one task should sort, it is sketched again from within.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import cut_lineage, written

#: The rank error of a sketch is at most 1/ACCURACY of the records it saw.
ACCURACY = 2000
#: Records of one group that one task sorts at most, unless they share fewer scores than that.
SORTED = 1_000_000


def scored_once(df: DataFrame, group: str, key: list[str], score: str, least: float, most: float) -> DataFrame:
    """(group, key …, score) once per group and key, with its highest score.

    Only scores from least to most count; rows without group or with another, null or NaN score are left out. Null parts
    of the key are equal to each other. -0.0 is 0.0.
    """
    p = F.col(score)
    return df.where(F.col(group).isNotNull() & p.isNotNull() & ~F.isnan(p) & p.between(least, most)).groupBy(group, *key).agg(F.max(p + F.lit(0.0)).alias(score))


def _sketch(scored: DataFrame, group: str, score: str, needs: DataFrame, accuracy: int) -> DataFrame:
    """(group, lo, hi) around the score at the wanted rank from above. needs: (group, share) with the share in thousandths of
    1/16, so that the sketch answers at most 16,001 probes whatever the number of groups."""
    grid = sorted({r[0] for r in needs.select("share").distinct().limit(16_002).collect()} | {0})
    margin = 2.0 / accuracy + 1.0 / 16_000
    probes = sorted({min(1.0, max(0.0, 1 - g / 16_000 + d)) for g in grid for d in (-margin, margin)})
    at = {p: i for i, p in enumerate(probes)}
    sketched = scored.groupBy(group).agg(F.percentile_approx(score, probes, accuracy).alias("v"))
    lo = F.create_map(*(F.lit(x) for g in grid for x in (g, at[min(1.0, max(0.0, 1 - g / 16_000 - margin))])))
    hi = F.create_map(*(F.lit(x) for g in grid for x in (g, at[min(1.0, max(0.0, 1 - g / 16_000 + margin))])))
    return sketched.join(needs, group).select(group, F.get("v", lo[F.col("share")]).alias("lo"), F.get("v", hi[F.col("share")]).alias("hi"))


def _share(rank: Column, n: Column) -> Column:
    return F.least(F.lit(16_000), F.greatest(F.lit(0), F.rint(rank * 16_000 / n))).cast("int").alias("share")


def keep_fraction(scored: DataFrame, group: str, score: str, targets: DataFrame, permille: str, accuracy: int = ACCURACY, most_sorted: int = SORTED) -> tuple[DataFrame, DataFrame]:
    """The rows at or above their group's cutoff, and per group: cutoff, n, n_kept, and lo, hi, n_above, n_inside of its last bracket.

    The cutoff is the highest score such that at least permille * n / 1000 of the group's rows, and at least one, have it or
    more. Groups without a target, or without rows, are left out; of several targets of a group the highest holds. All ties
    at the cutoff are kept. scored: as scored_once returns it, read several times, so written to the shared folder.
    """
    given_group = group
    # names of its own, so that none clashes with those of this function
    inner = {c: f"__{i}" for i, c in enumerate(scored.columns)}
    scored, group, score = written(scored.toDF(*inner.values()), "scored"), inner[group], inner[score]
    targets = targets.select(F.col(given_group).alias(group), F.col(permille).alias("__p"))
    permille = "__p"
    targets = targets.where(F.col(group).isNotNull() & F.col(permille).isNotNull()).groupBy(group).agg(F.max(permille).cast("long").alias("permille"))
    sizes = scored.groupBy(group).agg(F.count("*").alias("n"))
    need = F.greatest(F.lit(1).cast("long"), F.least(F.col("n"), F.expr("(permille * n + 999) div 1000")))
    state = cut_lineage(sizes.join(targets, group).select(group, "n", need.alias("need")))

    def inside(brackets: DataFrame) -> DataFrame:
        return scored.join(brackets.select(group, "lo", "hi"), group).where((F.col(score) >= F.col("lo")) & (F.col(score) <= F.col("hi")))

    def counted(brackets: DataFrame) -> DataFrame:
        """brackets with the number of rows above and inside."""
        p = scored.join(brackets.select(group, "lo", "hi"), group).where(F.col(score) >= F.col("lo"))
        return brackets.join(p.groupBy(group).agg(F.count_if(F.col(score) > F.col("hi")).alias("n_above"), F.count_if(F.col(score) <= F.col("hi")).alias("n_inside")), group)

    brackets = cut_lineage(counted(state.join(_sketch(scored, group, score, state.select(group, _share(F.col("need"), F.col("n"))), accuracy), group)))
    held = (F.col("n_above") < F.col("need")) & (F.col("need") <= F.col("n_above") + F.col("n_inside"))
    # The sketch's bound makes this hold; were it not to, the whole range is taken and narrowed below. Nothing rests on trust.
    if brackets.where(~held).limit(1).count():
        ends = scored.groupBy(group).agg(F.min(score).alias("all_lo"), F.max(score).alias("all_hi"))
        whole = brackets.withColumn("missed", ~held).join(ends, group)
        lo, hi = F.when(F.col("missed"), F.col("all_lo")).otherwise(F.col("lo")), F.when(F.col("missed"), F.col("all_hi")).otherwise(F.col("hi"))
        brackets = cut_lineage(counted(whole.select(group, "n", "need", lo.alias("lo"), hi.alias("hi"))))
    before = -1
    while (left := brackets.where((F.col("n_inside") > most_sorted) & (F.col("lo") < F.col("hi"))).agg(F.sum("n_inside")).first()[0]) and left != before:
        before = left
        wide = brackets.where((F.col("n_inside") > most_sorted) & (F.col("lo") < F.col("hi")))
        again = _sketch(inside(wide), group, score, wide.select(group, _share(F.col("need") - F.col("n_above"), F.col("n_inside"))), accuracy)
        narrower = counted(wide.select(group, "n", "need").join(again, group)).where(held)
        rest = brackets.join(narrower.select(group), group, "left_anti")
        brackets = cut_lineage(rest.unionByName(narrower.select(*rest.columns)))
    # of the bracketed rows, one row per score reaches the sort
    scores = inside(brackets).groupBy(group, score).agg(F.count("*").alias("c"))
    down = Window.partitionBy(group).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = scores.withColumn("upto", F.sum("c").over(down)).join(brackets, group).where(F.col("n_above") + F.col("upto") >= F.col("need"))
    report = cut_lineage(
        reached.groupBy(group).agg(F.max(score).alias("cutoff"), (F.first("n_above") + F.min("upto")).alias("n_kept"), *(F.first(c).alias(c) for c in ("n", "lo", "hi", "n_above", "n_inside")))
    )
    kept = scored.join(report.select(group, "cutoff"), group).where(F.col(score) >= F.col("cutoff"))
    return kept.select(*(F.col(v).alias(k) for k, v in inner.items())), report.withColumnRenamed(group, given_group)
