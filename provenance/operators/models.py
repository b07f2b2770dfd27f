"""Learned combinations of model probabilities, by pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decisions import logp
from .evaluation import P
from .weights import class_balanced


def wide(df: DataFrame, keys: list[str], members: list[str]) -> DataFrame:
    """A row a sample with log-probabilities x<model>_<class> of all members; samples that one lacks are left out."""
    xs = {f"x{i}_{c}": F.max(F.when(F.col("model") == m, logp(F.col(p)))) for i, m in enumerate(members) for c, p in enumerate(P)}
    w = df.where(F.col("model").isin(members)).groupBy(*keys).agg(F.min("y").alias("y"), *(x.alias(n) for n, x in xs.items()))
    return w.dropna(subset=list(xs))


def features(members: list[str]) -> list[str]:
    return [f"x{i}_{c}" for i in range(len(members)) for c in range(len(P))]


def stacked(train: DataFrame, xs: list[str], c: float = 1.0, scale: bool = False) -> PipelineModel:
    """Multinomial regression on xs with class-balanced weights; the penalty is the one of strength C over summed losses."""
    rows = class_balanced(train, "y").withColumn("label", F.col("y").cast("double"))
    n = max(1, rows.count())
    stages = [VectorAssembler(inputCols=xs, outputCol="raw"), *([StandardScaler(inputCol="raw", outputCol="v", withMean=True)] if scale else [])]
    lr = LogisticRegression(featuresCol="v" if scale else "raw", family="multinomial", weightCol="weight", standardization=False, regParam=1 / (c * n), maxIter=200)
    return Pipeline(stages=[*stages, lr]).fit(rows)


def predicted(model: PipelineModel, rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y and the three probabilities; classes that training lacked have 0."""
    p = vector_to_array("probability")
    return model.transform(rows).select(*keys, "y", *(F.coalesce(F.get(p, F.lit(k)), F.lit(0.0)).alias(name) for k, name in enumerate(P)))


def reliability_design(df: DataFrame, xs: list[str], rel: list[str], val: DataFrame) -> tuple[DataFrame, list[str]]:
    """xs, their products with the indicators rel, and rel: nulls take the validation median, then mean 0 and deviation 1 by the validation rows."""
    filled = Imputer(strategy="median", inputCols=rel, outputCols=[f"{r}_f" for r in rel]).fit(val)
    stats = filled.transform(val).agg(*(f(f"{r}_f").alias(f"{r}_{n}") for r in rel for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    out = filled.transform(df).withColumns({f"{r}_z": (F.col(f"{r}_f") - F.lit(stats[f"{r}_m"] or 0.0)) / F.lit((stats[f"{r}_s"] or 0.0) + 1e-9) for r in rel})
    names = [*xs, *(f"{x}_{r}" for x in xs for r in rel), *(f"{r}_z" for r in rel)]
    return out.withColumns({f"{x}_{r}": F.col(x) * F.col(f"{r}_z") for x in xs for r in rel}), names


def impute_scale(train: DataFrame, rows: DataFrame, xs: list[str]) -> DataFrame:
    """Nulls and NaN take the training median, then mean 0 and sample deviation 1 by the training rows."""
    clean = lambda d: d.withColumns({x: F.nanvl(x, F.lit(None).cast("double")) for x in xs})
    imputer = Imputer(strategy="median", inputCols=xs, outputCols=[f"{x}_f" for x in xs]).fit(clean(train))
    filled = imputer.transform(clean(train))
    s = filled.agg(*(f(f"{x}_f").alias(f"{x}_{n}") for x in xs for n, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
    return imputer.transform(clean(rows)).withColumns({x: (F.col(f"{x}_f") - F.lit(s[f"{x}_m"])) / F.lit(s[f"{x}_s"] or 1.0) for x in xs}).drop(*(f"{x}_f" for x in xs))


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, part) with k parts of like size: groups from the largest, each to the smallest part so far. A row a group, dealt on one task; groups are cameras."""
    import pandas as pd

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", group], ascending=[False, True], kind="stable")
        sums, part = [0] * k, []
        for n in pdf["n"]:
            i = sums.index(min(sums))
            sums[i] += n
            part.append(i)
        return pd.DataFrame({group: pdf[group], "part": part})

    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    return sizes.withColumn("__one", F.lit(1)).groupBy("__one").applyInPandas(deal, f"`{group}` {df.schema[group].dataType.simpleString()}, part int")
