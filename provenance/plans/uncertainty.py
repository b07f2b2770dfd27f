"""Queries of resampling and tests over predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import statistics as S
from ..sources.tables import cut_lineage
from .evaluation import SCORED, scored

RESAMPLES = 2000
PAIR = ("svm", "xgb")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test samples of both models: (claimed_device, a, b), whether each is right."""
    s = scored(spark, sf_dir).where(F.col("model").isin(*PAIR) & (F.col("part") == "test"))
    ok = F.when(F.col("y") == F.col("pred"), 1).otherwise(0)
    both = s.groupBy("split_name", "sample_id").agg(F.min("claimed_device").alias("claimed_device"), F.min("y").alias("y"), *(F.max(F.when(F.col("model") == m, ok)).alias(n) for m, n in zip(PAIR, "ab")), *(F.max(F.when(F.col("model") == m, F.col("pred"))).alias(f"p{n}") for m, n in zip(PAIR, "ab")))
    return both.where("a is not null and b is not null")


def _f1(model: str):
    """Macro F1 over the classes present, out of summed counts."""
    terms = [2.0 * F.col(f"{model}_tp{c}") / F.greatest(F.lit(1), F.col(f"t{c}") + F.col(f"{model}_p{c}")) for c in range(3)]
    here = [F.when(F.col(f"t{c}") > 0, 1).otherwise(0) for c in range(3)]
    return sum(h * t for h, t in zip(here, terms)) / sum(here)


def _sums() -> dict:
    out = {"n": F.lit(1), "a": F.col("a"), "b": F.col("b")}
    for c in range(3):
        out[f"t{c}"] = (F.col("y") == c).cast("int")
        for m in "ab":
            out[f"{m}_tp{c}"] = ((F.col("y") == c) & (F.col(f"p{m}") == c)).cast("int")
            out[f"{m}_p{c}"] = (F.col(f"p{m}") == c).cast("int")
    return out


def _resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = cut_lineage(S.cluster_sums(_hits(spark, sf_dir), "claimed_device", _sums()))
    return S.resampled(per, "claimed_device", list(_sums()), RESAMPLES)


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and macro F1 of both models over 2,000 resamples of cameras: 95 % intervals."""
    b = _resampled(spark, sf_dir).select(F.explode(F.array(
        *(F.struct(F.lit(m).alias("model"), F.lit("accuracy").alias("metric"), (F.col(x) / F.col("n")).alias("v")) for m, x in zip(PAIR, "ab")),
        *(F.struct(F.lit(m).alias("model"), F.lit("macro_f1").alias("metric"), _f1(x).alias("v")) for m, x in zip(PAIR, "ab")),
    )).alias("x")).select("x.*")
    return b.groupBy("model", "metric").agg(F.count("v").alias("resamples"), *(F.round(c, 6).alias(n) for n, c in zip(("low", "high"), S.interval(b, [], "v"))))


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference of both models' accuracy and macro F1 over the same resamples: interval and two-sided p."""
    b = _resampled(spark, sf_dir).select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("metric"), ((F.col("a") - F.col("b")) / F.col("n")).alias("d")), F.struct(F.lit("macro_f1").alias("metric"), F.round(_f1("a") - _f1("b"), 12).alias("d")),
    )).alias("x")).select("x.*")
    return b.groupBy("metric").agg(*(F.round(c, 6).alias(n) for n, c in zip(("low", "high"), S.interval(b, [], "d"))), F.round(S.two_sided(F.col("d"), RESAMPLES), 6).alias("p"))


def discordant(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hits(spark, sf_dir)
    return h.agg(F.count("*").alias("n"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_svm"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_xgb"))


def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts with the exact p-value and its mark."""
    p = F.udf(S.mcnemar, "double")  # of one row
    mark = F.when(F.col("p") < 0.001, "***").when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").otherwise("")
    return discordant(spark, sf_dir).withColumn("p", p("only_svm", "only_xgb")).withColumn("mark", mark)


QUERIES = {"cluster_bootstrap_ci": intervals, "paired_p": paired, "mcnemar_counts": discordant, "mcnemar_p": mcnemar}

_HITS = f"{SCORED}, h AS (SELECT split_name, sample_id, min(claimed_device) AS cam, min(y) AS y, max((y = pred)::INT) FILTER (model = 'svm') AS a, max((y = pred)::INT) FILTER (model = 'xgb') AS b, max(pred) FILTER (model = 'svm') AS pa, max(pred) FILTER (model = 'xgb') AS pb FROM s WHERE model IN ('svm', 'xgb') AND part = 'test' GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL)"
_NAMES = ["n", "a", "b", *(x for c in range(3) for x in (f"t{c}", f"a_tp{c}", f"a_p{c}", f"b_tp{c}", f"b_p{c}"))]
_PER = ", ".join(f"count(*) FILTER (y = {c}) AS t{c}, " + ", ".join(f"count(*) FILTER (y = {c} AND p{m} = {c}) AS {m}_tp{c}, count(*) FILTER (p{m} = {c}) AS {m}_p{c}" for m in "ab") for c in range(3))
_BOOT = f"""{_HITS}, pc AS (SELECT cam, row_number() OVER (ORDER BY cam) - 1 AS k, * EXCLUDE cam FROM (SELECT cam, count(*) AS n, sum(a) AS a, sum(b) AS b, {_PER} FROM h WHERE cam IS NOT NULL GROUP BY ALL)), nn AS (SELECT count(*) AS m FROM pc),
 dr AS (SELECT i, ('0x' || substr(md5(i || ':' || j), 1, 7))::BIGINT % m AS k FROM nn, range(2000) t(i), range((SELECT m FROM nn)) u(j)), bs AS (SELECT i, {', '.join(f'sum({x})::DOUBLE AS {x}' for x in _NAMES)} FROM dr JOIN pc USING (k) GROUP BY ALL)"""


def _sql_f1(m: str) -> str:
    top = " + ".join(f"(t{c} > 0)::INT * 2.0 * {m}_tp{c} / greatest(1, t{c} + {m}_p{c})" for c in range(3))
    return f"(({top}) / ({' + '.join(f'(t{c} > 0)::INT' for c in range(3))}))"


SQL = {
    "cluster_bootstrap_ci": f"WITH {_BOOT}, v AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, '{k}' AS metric, {e} AS v FROM bs" for m, x in zip(PAIR, "ab") for k, e in (("accuracy", f"{x} / n"), ("macro_f1", _sql_f1(x)))) + ") SELECT model, metric, count(*) AS resamples, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM v GROUP BY ALL",
    "paired_p": f"WITH {_BOOT}, v AS (SELECT 'accuracy' AS metric, (a - b) / n AS d FROM bs UNION ALL SELECT 'macro_f1', round({_sql_f1('a')} - {_sql_f1('b')}, 12) FROM bs) SELECT metric, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, round(least(1.0, greatest(1 / 2000.0, 2 * least(avg((d <= 0)::INT), avg((d >= 0)::INT)))), 6) AS p FROM v GROUP BY ALL",
    "mcnemar_counts": f"WITH {_HITS} SELECT count(*) AS n, count(*) FILTER (a = 1 AND b = 0) AS only_svm, count(*) FILTER (a = 0 AND b = 1) AS only_xgb FROM h",
}
