"""Metrics of classifiers: confusion, three macro F1 scores, ROC, calibration, risk and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running

CLASSES = ("organic", "manipulated", "synthetic")
P = [f"p_{c}" for c in CLASSES]


def once(predictions: DataFrame) -> DataFrame:
    """The first delivery of each (model, split_name, sample_id). One pass with partial aggregation, no window."""
    key = ["model", "split_name", "sample_id"]
    rest = [c for c in predictions.columns if c not in key]
    return predictions.groupBy(*key).agg(F.min_by(F.struct(*rest), "row_id").alias("__r")).select(*key, "__r.*")


def with_scores(predictions: DataFrame) -> DataFrame:
    """Predictions of a named model whose three probabilities are numbers from 0 to 1, with y, the class of label, and pred, the first of the most likely classes."""
    ok = F.col("model").isNotNull()
    for p in P:
        ok = ok & F.col(p).between(0.0, 1.0)
    return predictions.where(ok).withColumns({"y": class_code(F.col("label")), "pred": argmax(*(F.col(p) for p in P))})


def class_code(label: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, CLASSES)), label) - 1).cast("int")


def argmax(*xs: Column) -> Column:
    """The place of the greatest, the first of equals."""
    a = F.array(*xs)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def confusion(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by, "y", "pred").agg(F.count("*").alias("n"))


def class_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Per group, in one pass: n, hits, and for each class c: tp_c, t_c (true), p_c (predicted)."""
    counts = [F.count("*").alias("n"), F.count_if(F.col("y") == F.col("pred")).alias("hits")]
    for c in range(len(CLASSES)):
        counts += [F.count_if((F.col("y") == c) & (F.col("pred") == c)).alias(f"tp_{c}"), F.count_if(F.col("y") == c).alias(f"t_{c}"), F.count_if(F.col("pred") == c).alias(f"p_{c}")]
    return df.groupBy(*by).agg(*counts)


def _f1(c: int) -> Column:
    return 2.0 * F.col(f"tp_{c}") / F.greatest(F.lit(1), F.col(f"t_{c}") + F.col(f"p_{c}"))


def macro_f1(counts: DataFrame, name: str, over: str) -> DataFrame:
    """counts with macro F1 over the classes `present` in y, over the `union` of y and pred, or over all three (`fixed`)."""
    counted = {"present": lambda c: F.col(f"t_{c}") > 0, "union": lambda c: (F.col(f"t_{c}") > 0) | (F.col(f"p_{c}") > 0), "fixed": lambda c: F.lit(True)}[over]
    total = sum(F.when(counted(c), _f1(c)).otherwise(0.0) for c in range(3))
    return counts.withColumn(name, total / sum(F.when(counted(c), 1).otherwise(0) for c in range(3)))


def precision_recall(counts: DataFrame) -> DataFrame:
    """counts with macro precision and recall over present classes; 0 where nothing was predicted."""
    here = [F.when(F.col(f"t_{c}") > 0, 1).otherwise(0) for c in range(3)]
    return counts.withColumns({
        "precision": sum(h * F.col(f"tp_{c}") / F.greatest(F.lit(1), F.col(f"p_{c}")) for c, h in enumerate(here)) / sum(here),
        "recall": sum(h * F.col(f"tp_{c}") / F.greatest(F.lit(1), F.col(f"t_{c}")) for c, h in enumerate(here)) / sum(here),
    })


def roc(df: DataFrame, by: list[str], positive: Column, score: Column) -> DataFrame:
    """(by, score, pos, neg, tp, fp, next_pos, next_neg): a row per distinct score, highest first, with running counts. Null and NaN scores are left out."""
    rows = df.where(score.isNotNull() & ~F.isnan(score)).groupBy(*by, (score + F.lit(0.0)).alias("score")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    return running(rows, by, [F.desc("score")], {"tp": "pos", "fp": "neg"}, {"next_pos": "pos", "next_neg": "neg"})


def auc(curve: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_pos, n_neg, auc), ties counted half; null with one class only."""
    wins = F.sum(F.col("pos") * F.col("fp") * 2 - F.col("pos") * F.col("neg"))
    sums = curve.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), wins.alias("lost2"))
    return sums.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), 1.0 - F.col("lost2") / (2.0 * F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def _rates(curve: DataFrame, by: list[str]) -> DataFrame:
    total = curve.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")).where("n_pos > 0 and n_neg > 0")
    on = F.lit(True)
    for c in by:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return curve.alias("a").join(total.alias("b"), on).select("a.*", "n_pos", "n_neg").withColumns({"tpr": F.col("tp") / F.col("n_pos"), "fpr": F.col("fp") / F.col("n_neg")})


def eer(curve: DataFrame, by: list[str]) -> DataFrame:
    """(by, eer): the mean of fpr and fnr at the corner of the ROC where they are nearest, the highest score of equals; the start (0, 0) is a corner.

    A point is a corner unless it lies amid a straight piece of equal steps. Groups of one class are left out.
    """
    r = _rates(curve, by)
    corner = F.col("next_pos").isNull() | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg")) | ((F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg")))
    points = r.where(corner).select(*by, "fpr", "tpr", F.struct(F.abs(F.col("fpr") - (1 - F.col("tpr"))).alias("d"), (-F.col("score")).alias("o")).alias("k"))
    start = r.select(*by).distinct().select(*by, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.struct(F.lit(1.0).alias("d"), F.lit(float("-inf")).alias("o")).alias("k"))
    return points.union(start).groupBy(*by).agg(F.min_by((F.col("fpr") + 1 - F.col("tpr")) / 2, "k").alias("eer"))


def tpr_at(curve: DataFrame, by: list[str], fpr: float) -> DataFrame:
    """(by, tpr_at_fpr) by straight lines between the points of the ROC."""
    r = _rates(curve, by)
    low = F.max(F.when(F.col("fpr") <= fpr, F.struct("fpr", "tpr")))
    high = F.min(F.when(F.col("fpr") > fpr, F.struct("fpr", "tpr")))
    ends = r.groupBy(*by).agg(F.coalesce(low, F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))).alias("l"), high.alias("h"))
    return ends.select(*by, F.when(F.col("h").isNull(), F.col("l.tpr")).otherwise(F.col("l.tpr") + (F.lit(fpr) - F.col("l.fpr")) * (F.col("h.tpr") - F.col("l.tpr")) / (F.col("h.fpr") - F.col("l.fpr"))).alias("tpr_at_fpr"))


def normalised(df: DataFrame) -> DataFrame:
    """Probabilities that add up to one; rows of sum 0 are left out."""
    total = sum(F.col(p) for p in P)
    return df.where(total > 0).withColumns({p: F.col(p) / total for p in P})


def bin_of(conf: Column, bins: int) -> Column:
    """The bin of 0 … bins - 1 by the edges k / bins, an edge belonging to the bin above. Compared with the edges themselves, not by division."""
    return sum(F.when(conf >= k / bins, 1).otherwise(0) for k in range(1, bins)).cast("int")


def calibration(df: DataFrame, by: list[str], bins: int = 15) -> DataFrame:
    """(by, n, ece, brier, log_loss, entropy): expected calibration error over equal bins, Brier score, mean -log p and mean normalised entropy."""
    conf = F.greatest(*P)
    hit = (F.col("y") == F.col("pred")).cast("double")
    own = F.element_at(F.array(*P), F.col("y") + 1)
    brier = sum((F.col(p) - F.when(F.col("y") == k, 1.0).otherwise(0.0)) ** 2 for k, p in enumerate(P))
    entropy = -sum(F.col(p) * F.log(F.greatest(F.col(p), F.lit(1e-12))) for p in P) / F.log(F.lit(3.0))
    per_bin = df.groupBy(*by, bin_of(conf, bins).alias("bin")).agg(F.count("*").alias("m"), F.sum(hit).alias("h"), F.sum(conf).alias("c"), F.sum(brier).alias("b"), F.sum(-F.log(F.greatest(own, F.lit(1e-12)))).alias("l"), F.sum(entropy).alias("e"))
    n = F.sum("m")
    return per_bin.groupBy(*by).agg(n.alias("n"), (F.sum(F.abs(F.col("h") - F.col("c"))) / n).alias("ece"), (F.sum("b") / n).alias("brier"), (F.sum("l") / n).alias("log_loss"), (F.sum("e") / n).alias("entropy"))


def risk_coverage(df: DataFrame, by: list[str], uncertainty: Column, order: list[str], at: tuple[float, ...]) -> DataFrame:
    """(by, aurc, risk_100 …): the error among the most certain rows at each coverage, and its mean over all coverages. `order` breaks ties."""
    rows = df.select(*by, uncertainty.alias("u"), *order, (F.col("y") != F.col("pred")).cast("long").alias("err"), F.lit(1).cast("long").alias("one"))
    r = running(rows, by, [F.asc("u"), *(F.asc(c) for c in order)], {"errs": "err", "k": "one"})
    total = rows.groupBy(*by).agg(F.count("*").alias("n"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    risk = F.col("errs") / F.col("k")
    picks = [F.max(F.when(F.col("k") == F.greatest(F.lit(1), F.bround(F.col("n") * c).cast("long")), risk)).alias(f"risk_{round(c * 100)}") for c in at]
    return r.alias("a").join(total.alias("b"), on).select("a.*", "n").groupBy(*by).agg(F.avg(risk).alias("aurc"), *picks)
