"""Queries of the evaluation layer over predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions as D
from ..operators import evaluation as E
from ..sources.tables import table

BY = ["model", "part", "split_name"]
P = E.P


#: Added before rounding where exact halves are common, so that no last digit hangs on the order of a sum.
NUDGE = 1e-9


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.once(table(spark, sf_dir, "predictions"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.with_scores(predictions(spark, sf_dir))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.class_counts(scored(spark, sf_dir), BY)


ONCE = "SELECT * FROM predictions QUALIFY row_number() OVER (PARTITION BY model, split_name, sample_id ORDER BY row_id) = 1"
SCORED = f"""p AS ({ONCE}), s AS (SELECT *, CASE label WHEN 'organic' THEN 0 WHEN 'manipulated' THEN 1 ELSE 2 END AS y,
 CASE WHEN p_organic >= p_manipulated AND p_organic >= p_synthetic THEN 0 WHEN p_manipulated >= p_synthetic THEN 1 ELSE 2 END AS pred
 FROM p WHERE model IS NOT NULL AND p_organic BETWEEN 0 AND 1 AND p_manipulated BETWEEN 0 AND 1 AND p_synthetic BETWEEN 0 AND 1)"""
KEYS = "model, part, split_name"
COUNTS = f"""{SCORED}, k AS (SELECT {KEYS}, count(*) AS n, count(*) FILTER (y = pred) AS hits, {", ".join(f"count(*) FILTER (y = {c} AND pred = {c}) AS tp_{c}, count(*) FILTER (y = {c}) AS t_{c}, count(*) FILTER (pred = {c}) AS p_{c}" for c in range(3))} FROM s GROUP BY ALL)"""
_F = [f"(2.0 * tp_{c} / greatest(1, t_{c} + p_{c}))" for c in range(3)]
_HERE = [f"(t_{c} > 0)::INT" for c in range(3)]
_ANY = [f"(t_{c} > 0 OR p_{c} > 0)::INT" for c in range(3)]


def _mean(xs: list[str], on: list[str]) -> str:
    return f"({' + '.join(f'{h} * {x}' for h, x in zip(on, xs))}) / ({' + '.join(on)})"


_ROC = """, c AS (SELECT {by}, score + 0.0 AS score, count(*) FILTER (pos) AS pos, count(*) FILTER (NOT pos) AS neg FROM d WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
 r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, lead(pos) OVER o AS next_pos, lead(neg) OVER o AS next_neg, sum(pos) OVER (PARTITION BY {by}) AS n_pos, sum(neg) OVER (PARTITION BY {by}) AS n_neg
 FROM c WINDOW w AS (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING), o AS (PARTITION BY {by} ORDER BY score DESC))"""
_BIN = f"WITH {SCORED}, d AS (SELECT {KEYS}, p_organic AS score, y = 0 AS pos FROM s)" + _ROC.format(by=KEYS)
AUC = "CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round(1.0 - sum(pos * fp * 2 - pos * neg)::DOUBLE / (2.0 * sum(pos)::DOUBLE * sum(neg)::DOUBLE), 6) END"
EER = """, q AS (SELECT {by}, fp::DOUBLE / n_neg AS fpr, tp::DOUBLE / n_pos AS tpr, -score AS o FROM r WHERE n_pos > 0 AND n_neg > 0 AND (next_pos IS NULL OR next_pos <> pos OR next_neg <> neg OR (tp = pos AND fp = neg))
 UNION ALL SELECT DISTINCT {by}, 0.0, 0.0, '-infinity'::DOUBLE FROM r WHERE n_pos > 0 AND n_neg > 0)
 SELECT {by}, round((fpr + 1 - tpr) / 2, 6) AS eer FROM q QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY abs(fpr - (1 - tpr)), o) = 1"""


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.roc(scored(spark, sf_dir), BY, F.col("y") == 0, F.col("p_organic"))


def auc_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean one-against-rest AUC over the classes present, of probabilities made to add up to one over these; null with one class."""
    s = scored(spark, sf_dir)
    here = E.class_counts(s, BY).select(*BY, *(F.col(f"t_{c}") > 0 for c in range(3))).toDF(*BY, "h0", "h1", "h2")
    total = sum(F.when(F.col(f"h{c}"), F.col(P[c])).otherwise(0.0) for c in range(3))
    long = s.join(here, BY).withColumn("t", total).where("t > 0").select(*BY, "y", F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.when(F.col(f"h{c}"), F.round(F.col(P[c]) / F.col("t"), 9)).alias("s")) for c in range(3)))).alias("x")).where("x.s is not null")
    by = [*BY, "c"]
    a = E.auc(E.roc(long.select(*BY, "y", "x.c", "x.s"), by, F.col("y") == F.col("c"), F.col("s")), by)
    return a.groupBy(*BY).agg(F.avg("auc").alias("auc_ovr"))


def per_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection rate per condition: rows added up, rates averaged over the splits without weights; null keys are groups, null alpha is 0."""
    keys = ["label", "source", "variant", "social", "alpha", "stabilized"]
    s = scored(spark, sf_dir).where("part <> 'val'").withColumns({"alpha": F.coalesce(F.nanvl("alpha", F.lit(0.0)), F.lit(0.0)), "ok": (F.col("y") == F.col("pred")).cast("double")})
    one = s.groupBy(*BY, *keys).agg(F.count("*").alias("n"), F.avg("ok").alias("rate"))
    return one.groupBy("model", "part", *keys).agg(F.sum("n").alias("n"), F.round(F.avg("rate"), 6).alias("detection_rate"))


def fold_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and macro F1 over present classes: mean and standard deviation over the splits."""
    f = E.precision_recall(E.macro_f1(counts(spark, sf_dir), "f1", "present")).withColumn("pva", F.col("hits") / F.col("n"))
    return f.where("part <> 'val'").groupBy("model", "part").agg(*(F.round(fn(c), 6).alias(f"{c}_{name}_foldmean") for c in ("pva", "f1", "precision", "recall") for name, fn in (("mean", F.avg), ("std", F.stddev_samp))))


def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model whose name is another's with an ending _x: how much the shorter one is ahead."""
    f = E.macro_f1(counts(spark, sf_dir), "f1", "present").groupBy("model", "part").agg(F.avg("f1").alias("f1"))
    tag = f.select(F.regexp_extract("model", r"^([a-z]+)_(?:w\d+|no_.+)$", 1).alias("base"), F.col("model").alias("variant"), "part", F.col("f1").alias("variant_f1")).where("base <> ''")
    full = f.select(F.col("model").alias("base"), "part", "f1")
    return tag.join(full, ["base", "part"]).select("base", "variant", "part", *r6("f1", "variant_f1"), F.round(F.col("f1") - F.col("variant_f1"), 6).alias("f1_drop"))


def rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule models: genuine if the score is above the threshold."""
    p = predictions(spark, sf_dir).where("model is not null and score_organic is not null and not isnan(score_organic)")
    yes, real = F.col("score_organic") > F.col("threshold"), F.col("label") == "organic"
    c = p.groupBy(*BY).agg(F.count("*").alias("n"), F.count_if(yes & real).alias("tp"), F.count_if(yes & ~real).alias("fp"), F.count_if(~yes & real).alias("fn"))
    prec, rec = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp")), F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))
    return c.select(*BY, "n", F.round((F.col("n") - F.col("fp") - F.col("fn")) / F.col("n"), 6).alias("bin_acc"), F.round(prec, 6).alias("bin_precision"), F.round(rec, 6).alias("bin_recall"), F.round(F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0), 6).alias("bin_f1"))


VOTERS = ["svm", "xgb"]
SAMPLE = ["sample_id", "part", "split_name"]


def vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.soft_vote(scored(spark, sf_dir), SAMPLE, VOTERS).select(*SAMPLE, "y", *r6(*P))


def top3_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split the three models best on validation; equal scores by name."""
    f = E.macro_f1(E.class_counts(scored(spark, sf_dir).where("part = 'val'"), ["split_name", "model"]), "f1", "fixed").withColumn("f1", F.round("f1", 9))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("f1")).alias("o"), "model", "f1"))), 1, 3)  # as many entries as models
    return f.groupBy("split_name").agg(best.alias("b")).select("split_name", F.posexplode("b").alias("rank", "x")).select("split_name", (F.col("rank") + 1).alias("rank"), "x.model", F.round("x.f1", 6).alias("f1"))


def disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sample: how many models, the share whose class is not the mean's, the spread of p_organic."""
    s = scored(spark, sf_dir)
    mean = s.groupBy(*SAMPLE).agg(*(F.avg(p).alias(f"m{k}") for k, p in enumerate(P)), F.count("*").alias("models"), F.stddev_pop("p_organic").alias("spread"), *(F.count_if(F.col("pred") == c).alias(f"v{c}") for c in range(3)))
    own = E.argmax(*(F.round(f"m{k}", 9) for k in range(3)))
    return mean.select(*SAMPLE, "models", F.round(1 - F.element_at(F.array("v0", "v1", "v2"), own + 1) / F.col("models"), 6).alias("disagree"), F.round("spread", 6).alias("spread"))


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best offsets of every model on its validation rows, over the full 61 x 61 grid."""
    by = ["model", "split_name"]
    g = D.offset_f1(scored(spark, sf_dir).where("part = 'val'"), by).withColumn("f1", F.round("f1", 9))
    return D.best_offsets(g, by).select(*by, *r6("b1", "b2", "f1", "f1_plain"))


def safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.safe_boost(scored(spark, sf_dir).where("part = 'val'"), ["model", "split_name"]).select("model", "split_name", *r6("boost"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.zone_thresholds(scored(spark, sf_dir).where("part = 'val'"), ["model", "split_name"]).select("model", "split_name", *r6("lo", "hi"))


def zone_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every class of the other parts: how many are accepted, called manipulated, called synthetic and left open."""
    by = ["model", "split_name"]
    s = scored(spark, sf_dir)
    t = D.zone_thresholds(s.where("part = 'val'"), by).select(*by, F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))
    z = s.where("part <> 'val'").join(t, by).withColumn("zone", D.zone(F.col("lo"), F.col("hi")))
    return z.groupBy("model", "label").agg(F.count("*").alias("n"), *(F.count_if(F.col("zone") == k).alias(name) for k, name in ((0, "accepted"), (1, "manipulated"), (2, "synthetic"), (-1, "inconclusive"))))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.calibration(E.normalised(scored(spark, sf_dir)), BY)
    return out.select(*BY, "n", *(F.round(F.col(c) + NUDGE, 6).alias(c) for c in ("ece", "brier", "log_loss", "entropy")))


def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.normalised(scored(spark, sf_dir))
    conf = F.greatest(*P)
    return s.groupBy("model", E.bin_of(conf, 15).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(conf) + NUDGE, 6).alias("confidence"), F.round(F.avg((F.col("y") == F.col("pred")).cast("double")), 6).alias("accuracy"))


COVER = (1.0, 0.8, 0.5)


def risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk and coverage by 1 - confidence, as it stands; equal ones in the order of split and sample."""
    s = scored(spark, sf_dir).where("part <> 'val'")
    return E.risk_coverage(s, ["model"], F.round(1 - F.greatest(*P), 9), ["split_name", "sample_id"], COVER).select("model", *r6("aurc", *(f"risk_{round(c * 100)}" for c in COVER)))


def clip_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten kinds of samples by ordered rules, and how often each is called right."""
    lab, var, soc = F.col("label"), F.col("variant"), F.col("social")
    kind = (
        F.when((lab == "organic") & (var == "native"), "genuine: native").when((lab == "organic") & soc.isin("wa-real", "yt-real"), "genuine: real copy").when((lab == "organic") & (soc == "none"), "genuine: re-encoded").when(lab == "organic", "genuine: platform-like")
        .when((lab == "manipulated") & (soc == "none") & var.startswith("injection"), "attacked: injection").when((lab == "manipulated") & (soc == "none"), "attacked: other").when(lab == "manipulated", "attacked: platform-like")
        .when((lab == "synthetic") & var.rlike(r"\+inj"), "synthetic: injected").when((lab == "synthetic") & (soc == "none"), "synthetic: plain").when(lab == "synthetic", "synthetic: platform-like").otherwise("other")
    )
    return scored(spark, sf_dir).groupBy("model", kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("y") == F.col("pred")).cast("double")), 6).alias("right"))


def spoof_by_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injected samples called genuine, per strength."""
    s = scored(spark, sf_dir).where(F.col("variant").rlike("inj") & F.col("alpha").isNotNull() & ~F.isnan("alpha"))
    return s.groupBy("model", "alpha").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred") == 0).cast("double")), 6).alias("accepted"))


def pivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of right decisions per model, a column for each class."""
    s = scored(spark, sf_dir).withColumn("ok", (F.col("y") == F.col("pred")).cast("double"))
    return s.groupBy("model").pivot("label", list(E.CLASSES)).agg(F.round(F.avg("ok"), 6))


def same_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """svm and xgb on the samples both have: accuracy, and their difference."""
    s = scored(spark, sf_dir).where(F.col("model").isin(VOTERS) & (F.col("part") == "test"))
    both = s.groupBy("split_name", "sample_id").agg(*(F.max(F.when(F.col("model") == m, (F.col("y") == F.col("pred")).cast("int"))).alias(m) for m in VOTERS)).where("svm is not null and xgb is not null")
    return both.groupBy("split_name").agg(F.count("*").alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in VOTERS), F.round(F.avg(F.col("xgb") - F.col("svm")), 6).alias("change"))


def _ids(s: DataFrame, m: str) -> DataFrame:
    return s.where(F.col("model") == m).select("split_name", "sample_id")


def id_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = predictions(spark, sf_dir)
    return _ids(s, "svm").intersect(_ids(s, "xgb"))


def id_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = predictions(spark, sf_dir)
    return _ids(s, "xgb").subtract(_ids(s, "svm"))


def complete_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that all of three models have."""
    s = predictions(spark, sf_dir).where(F.col("model").isin("svm", "xgb", "gru"))
    return s.groupBy("split_name", "sample_id").agg(F.count_distinct("model").alias("models")).where("models = 3").select("split_name", "sample_id")


def adaptive_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injected samples against a grid of thresholds on p_organic: those accepted by any model, per threshold."""
    s = scored(spark, sf_dir).where("label <> 'organic'").withColumn("t", F.explode(F.array(*(F.lit(x / 10) for x in range(3, 10)))))
    per = s.groupBy("sample_id", "t").agg(F.bool_or(F.col("p_organic") >= F.col("t")).alias("any"))
    return per.groupBy("t").agg(F.count("*").alias("n"), F.round(F.avg(F.col("any").cast("double")), 6).alias("evaded"))


def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of every model with Wilson's interval."""
    z = 1.96
    c = scored(spark, sf_dir).groupBy("model").agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("y") == F.col("pred")).alias("k"))
    p, n = F.col("k") / F.col("n"), F.col("n")
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return c.select("model", n.cast("bigint").alias("n"), F.round(p, 6).alias("acc"), F.round(mid - half, 6).alias("low"), F.round(mid + half, 6).alias("high"))


QUERIES = {
    "argmax_decision": lambda s, d: scored(s, d).select("row_id", "y", "pred"),
    "rule_decision": rule,
    "confusion": lambda s, d: E.confusion(scored(s, d), BY),
    "macro_f1_present": lambda s, d: E.precision_recall(E.macro_f1(counts(s, d), "f1", "present")).select(*BY, "n", *r6("f1", "precision", "recall")),
    "macro_f1_union": lambda s, d: E.macro_f1(counts(s, d), "f1", "union").select(*BY, *r6("f1")),
    "macro_f1_fixed3": lambda s, d: E.macro_f1(counts(s, d), "f1", "fixed").select(*BY, *r6("f1")),
    "accuracy_foldmean": fold_means, "per_variant_rates": per_variant, "ablation_deltas": ablation,
    "auc_binary": lambda s, d: E.auc(_curve(s, d), BY).select(*BY, "n_pos", "n_neg", *r6("auc")),
    "auc_ovr_macro": lambda s, d: auc_ovr(s, d).select(*BY, *r6("auc_ovr")),
    "eer": lambda s, d: E.eer(_curve(s, d), BY).select(*BY, *r6("eer")),
    "tpr_at_fpr": lambda s, d: E.tpr_at(_curve(s, d), BY, 0.05).select(*BY, *r6("tpr_at_fpr")),
    "soft_vote": vote, "top3_by_val": top3_models, "disagreement": disagreement, "offset_calibration": offsets, "safe_boost": safe,
    "three_zone_thresholds": zones, "three_zone_rates": zone_rates, "ece_brier_logloss": calibration, "reliability_bins": reliability_bins, "risk_coverage": risk,
    "clip_type_table": clip_types, "spoof_acceptance": spoof_by_strength, "pivot_correct": pivoted, "same_clips_compare": same_samples,
    "id_intersection": id_intersection, "id_difference": id_difference, "id_in_all_runs": complete_samples, "adaptive_grid_best": adaptive_best, "wilson_ci": wilson,
}

_N = "(p_organic + p_manipulated + p_synthetic)"
_NORM = f"{SCORED}, m AS (SELECT *, p_organic / {_N} AS a, p_manipulated / {_N} AS b, p_synthetic / {_N} AS c FROM s WHERE {_N} > 0), z AS (SELECT *, greatest(a, b, c) AS conf, (y = pred)::INT AS hit FROM m), e AS (SELECT *, {' + '.join(f'(conf >= {k / 15!r}::DOUBLE)::INT' for k in range(1, 15))} AS bin FROM z)"
_H = " - ".join(f"({x} * ln(greatest({x}, 1e-12)))" for x in "abc")
_LP = [f"ln(least(1.0, greatest(1e-6, {p})))" for p in P]
_ZONES = f"""{SCORED}, l AS (SELECT model, split_name, quantile_cont(p_organic, 0.05) AS lo FROM s WHERE part = 'val' AND y = 0 GROUP BY ALL),
 h AS (SELECT model, split_name, max(q) AS hi FROM (SELECT model, split_name, y, quantile_cont(p_organic, 0.95) AS q FROM s WHERE part = 'val' AND y > 0 GROUP BY ALL) GROUP BY ALL),
 t AS (SELECT model, split_name, CASE WHEN hi < lo THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN hi < lo THEN (lo + hi) / 2 ELSE hi END AS hi FROM l JOIN h USING (model, split_name))"""
SQL = {
    "argmax_decision": f"WITH {SCORED} SELECT row_id, y, pred FROM s",
    "rule_decision": f"""WITH p AS ({ONCE}), c AS (SELECT {KEYS}, count(*) AS n, count(*) FILTER (score_organic > threshold AND label = 'organic') AS tp, count(*) FILTER (score_organic > threshold AND label <> 'organic') AS fp, count(*) FILTER (NOT score_organic > threshold AND label = 'organic') AS fn FROM p WHERE model IS NOT NULL AND score_organic IS NOT NULL AND NOT isnan(score_organic) GROUP BY ALL),
 r AS (SELECT *, tp::DOUBLE / greatest(1, tp + fp) AS pr, tp::DOUBLE / greatest(1, tp + fn) AS re FROM c)
 SELECT {KEYS}, n, round((n - fp - fn)::DOUBLE / n, 6) AS bin_acc, round(pr, 6) AS bin_precision, round(re, 6) AS bin_recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS bin_f1 FROM r""",
    "confusion": f"WITH {SCORED} SELECT {KEYS}, y, pred, count(*) AS n FROM s GROUP BY ALL",
    "macro_f1_present": f"WITH {COUNTS} SELECT {KEYS}, n, round({_mean(_F, _HERE)}, 6) AS f1, round({_mean([f'tp_{c}::DOUBLE / greatest(1, p_{c})' for c in range(3)], _HERE)}, 6) AS precision, round({_mean([f'tp_{c}::DOUBLE / greatest(1, t_{c})' for c in range(3)], _HERE)}, 6) AS recall FROM k",
    "macro_f1_union": f"WITH {COUNTS} SELECT {KEYS}, round({_mean(_F, _ANY)}, 6) AS f1 FROM k",
    "macro_f1_fixed3": f"WITH {COUNTS} SELECT {KEYS}, round(({' + '.join(_F)}) / 3, 6) AS f1 FROM k",
    "accuracy_foldmean": f"WITH {COUNTS}, f AS (SELECT *, hits::DOUBLE / n AS pva, {_mean(_F, _HERE)} AS f1, {_mean([f'tp_{c}::DOUBLE / greatest(1, p_{c})' for c in range(3)], _HERE)} AS precision, {_mean([f'tp_{c}::DOUBLE / greatest(1, t_{c})' for c in range(3)], _HERE)} AS recall FROM k WHERE part <> 'val') SELECT model, part, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean_foldmean, round(stddev_samp({c}), 6) AS {c}_std_foldmean" for c in ("pva", "f1", "precision", "recall")) + " FROM f GROUP BY ALL",
    "per_variant_rates": f"WITH {SCORED}, o AS (SELECT {KEYS}, label, source, variant, social, CASE WHEN alpha IS NULL OR isnan(alpha) THEN 0 ELSE alpha END AS alpha, stabilized, count(*) AS n, avg((y = pred)::INT) AS rate FROM s WHERE part <> 'val' GROUP BY ALL) SELECT model, part, label, source, variant, social, alpha, stabilized, sum(n)::BIGINT AS n, round(avg(rate), 6) AS detection_rate FROM o GROUP BY ALL",
    "ablation_deltas": f"WITH {COUNTS}, f AS (SELECT model, part, avg({_mean(_F, _HERE)}) AS f1 FROM k GROUP BY ALL), t AS (SELECT regexp_extract(model, '^([a-z]+)_(?:w\\d+|no_.+)$', 1) AS base, model AS variant, part, f1 AS variant_f1 FROM f) SELECT base, variant, part, round(f.f1, 6) AS f1, round(variant_f1, 6) AS variant_f1, round(f.f1 - variant_f1, 6) AS f1_drop FROM t JOIN f ON f.model = base AND f.part = t.part WHERE base <> ''".replace("variant, part, round", "variant, t.part, round"),
    "auc_binary": f"{_BIN} SELECT {KEYS}, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, {AUC} AS auc FROM r GROUP BY ALL",
    "auc_ovr_macro": f"""WITH {COUNTS}, j AS (SELECT s.*, t_0 > 0 AS h0, t_1 > 0 AS h1, t_2 > 0 AS h2, (CASE WHEN t_0 > 0 THEN p_organic ELSE 0 END) + (CASE WHEN t_1 > 0 THEN p_manipulated ELSE 0 END) + (CASE WHEN t_2 > 0 THEN p_synthetic ELSE 0 END) AS t FROM s JOIN k USING ({KEYS})),
 d AS (SELECT {KEYS}, 0 AS cl, round(p_organic / t, 9) AS score, y = 0 AS pos FROM j WHERE t > 0 AND h0 UNION ALL SELECT {KEYS}, 1, round(p_manipulated / t, 9), y = 1 FROM j WHERE t > 0 AND h1 UNION ALL SELECT {KEYS}, 2, round(p_synthetic / t, 9), y = 2 FROM j WHERE t > 0 AND h2){_ROC.format(by=KEYS + ", cl")},
 a AS (SELECT {KEYS}, cl, {AUC.replace("round(", "(").replace(", 6)", ")")} AS auc FROM r GROUP BY ALL) SELECT {KEYS}, round(avg(auc), 6) AS auc_ovr FROM a GROUP BY ALL""",
    "eer": _BIN + EER.format(by=KEYS),
    "tpr_at_fpr": f"""{_BIN}, q AS (SELECT {KEYS}, fp::DOUBLE / n_neg AS fpr, tp::DOUBLE / n_pos AS tpr FROM r WHERE n_pos > 0 AND n_neg > 0 UNION ALL SELECT DISTINCT {KEYS}, 0.0, 0.0 FROM r WHERE n_pos > 0 AND n_neg > 0),
 b AS (SELECT {KEYS}, max(row(fpr, tpr)) FILTER (fpr <= 0.05) AS l, min(row(fpr, tpr)) FILTER (fpr > 0.05) AS h FROM q GROUP BY ALL)
 SELECT {KEYS}, round(CASE WHEN h IS NULL THEN l[2] ELSE l[2] + (0.05 - l[1]) * (h[2] - l[2]) / (h[1] - l[1]) END, 6) AS tpr_at_fpr FROM b""",
    "soft_vote": f"WITH {SCORED} SELECT sample_id, part, split_name, min(y) AS y, {', '.join(f'round(avg({p}), 6) AS {p}' for p in P)} FROM s WHERE model IN ('svm', 'xgb') GROUP BY sample_id, part, split_name HAVING count(*) = 2",
    "top3_by_val": f"WITH {COUNTS}, f AS (SELECT split_name, model, round(({' + '.join(_F)}) / 3, 9) AS f1 FROM k WHERE part = 'val') SELECT split_name, row_number() OVER (PARTITION BY split_name ORDER BY f1 DESC, model)::INT AS rank, model, round(f1, 6) AS f1 FROM f QUALIFY rank <= 3",
    "disagreement": f"""WITH {SCORED}, g AS (SELECT sample_id, part, split_name, round(avg(p_organic), 9) AS a, round(avg(p_manipulated), 9) AS b, round(avg(p_synthetic), 9) AS c, count(*) AS models, stddev_pop(p_organic) AS spread, count(*) FILTER (pred = 0) AS v0, count(*) FILTER (pred = 1) AS v1, count(*) FILTER (pred = 2) AS v2 FROM s GROUP BY ALL)
 SELECT sample_id, part, split_name, models, round(1 - (CASE WHEN a >= b AND a >= c THEN v0 WHEN b >= c THEN v1 ELSE v2 END)::DOUBLE / models, 6) AS disagree, round(spread, 6) AS spread FROM g""",
    "offset_calibration": f"""WITH {SCORED}, v AS (SELECT model, split_name, y, {_LP[0]} AS l0, {_LP[1]} AS l1, {_LP[2]} AS l2 FROM s WHERE part = 'val'), g AS (SELECT round(-3 + 0.1 * i, 10)::DOUBLE AS b1, round(-3 + 0.1 * j, 10)::DOUBLE AS b2, round(0.1 * (j - i), 10)::DOUBLE AS d FROM range(61) t(i), range(61) u(j)),
 o AS (SELECT model, split_name, b1, b2, y, CASE WHEN b1 > l0 - l1 AND NOT (b2 > l0 - l2 AND d > l1 - l2) THEN 1 WHEN b2 > l0 - l2 AND (NOT b1 > l0 - l1 OR d > l1 - l2) THEN 2 ELSE 0 END AS q FROM v, g),
 f AS (SELECT model, split_name, b1, b2, round(({' + '.join(f'2.0 * count(*) FILTER (y = {c} AND q = {c}) / greatest(1, count(*) FILTER (y = {c}) + count(*) FILTER (q = {c}))' for c in range(3))}) / 3, 9) AS f1 FROM o GROUP BY ALL),
 w AS (SELECT *, max(f1) FILTER (b1 = 0 AND b2 = 0) OVER (PARTITION BY model, split_name) AS f1_plain, row_number() OVER (PARTITION BY model, split_name ORDER BY f1 DESC, b1, b2) AS rn FROM f)
 SELECT model, split_name, CASE WHEN f1 > f1_plain THEN b1 ELSE 0 END AS b1, CASE WHEN f1 > f1_plain THEN b2 ELSE 0 END AS b2, round(f1, 6) AS f1, round(f1_plain, 6) AS f1_plain FROM w WHERE rn = 1""",
    "safe_boost": f"""WITH {SCORED}, v AS (SELECT model, split_name, greatest(0, ceil((greatest({_LP[1]}, {_LP[2]}) - {_LP[0]} - 1e-12) / 0.05)) AS k FROM s WHERE part = 'val' AND y = 0), g AS (SELECT model, split_name, i, count(*) FILTER (k <= i) AS ok, count(*) AS n FROM v, range(161) t(i) GROUP BY ALL)
 SELECT model, split_name, round(coalesce(min(i) FILTER (ok >= 0.95::DOUBLE * n) * 0.05, 8.0), 6)::DOUBLE AS boost FROM g GROUP BY ALL""",
    "three_zone_thresholds": f"WITH {_ZONES} SELECT model, split_name, round(lo, 6) AS lo, round(hi, 6) AS hi FROM t",
    "three_zone_rates": f"WITH {_ZONES}, z AS (SELECT s.model, label, CASE WHEN p_organic >= round(hi, 9) THEN 0 WHEN p_organic < round(lo, 9) THEN CASE WHEN p_manipulated >= p_synthetic THEN 1 ELSE 2 END ELSE -1 END AS zone FROM s JOIN t USING (model, split_name) WHERE part <> 'val') SELECT model, label, count(*) AS n, count(*) FILTER (zone = 0) AS accepted, count(*) FILTER (zone = 1) AS manipulated, count(*) FILTER (zone = 2) AS synthetic, count(*) FILTER (zone = -1) AS inconclusive FROM z GROUP BY ALL",
    "ece_brier_logloss": f"""WITH {_NORM}, g AS (SELECT {KEYS}, bin, count(*) AS m, sum(hit) AS h, sum(conf) AS cs, sum((a - (y = 0)::INT) ** 2 + (b - (y = 1)::INT) ** 2 + (c - (y = 2)::INT) ** 2) AS br, sum(-ln(greatest(CASE y WHEN 0 THEN a WHEN 1 THEN b ELSE c END, 1e-12))) AS ll, sum((- {_H}) / ln(3)) AS en FROM e GROUP BY ALL)
 SELECT {KEYS}, sum(m)::BIGINT AS n, round(sum(abs(h - cs)) / sum(m) + 1e-9, 6) AS ece, round(sum(br) / sum(m) + 1e-9, 6) AS brier, round(sum(ll) / sum(m) + 1e-9, 6) AS log_loss, round(sum(en) / sum(m) + 1e-9, 6) AS entropy FROM g GROUP BY ALL""",
    "reliability_bins": f"WITH {_NORM} SELECT model, bin, count(*) AS n, round(avg(conf) + 1e-9, 6) AS confidence, round(avg(hit), 6) AS accuracy FROM e GROUP BY ALL",
    "risk_coverage": f"""WITH {SCORED}, o AS (SELECT model, (y <> pred)::INT AS err, row_number() OVER w AS k, sum((y <> pred)::INT) OVER w AS errs, count(*) OVER (PARTITION BY model) AS n FROM s WHERE part <> 'val' WINDOW w AS (PARTITION BY model ORDER BY round(1 - greatest(p_organic, p_manipulated, p_synthetic), 9), split_name, sample_id ROWS UNBOUNDED PRECEDING))
 SELECT model, round(avg(errs::DOUBLE / k), 6) AS aurc, {', '.join(f'round(max(errs::DOUBLE / k) FILTER (k = greatest(1, round_even(n * {c}, 0)::BIGINT)), 6) AS risk_{round(c * 100)}' for c in COVER)} FROM o GROUP BY ALL""",
    "clip_type_table": f"""WITH {SCORED} SELECT model, CASE WHEN label = 'organic' AND variant = 'native' THEN 'genuine: native' WHEN label = 'organic' AND social IN ('wa-real', 'yt-real') THEN 'genuine: real copy' WHEN label = 'organic' AND social = 'none' THEN 'genuine: re-encoded' WHEN label = 'organic' THEN 'genuine: platform-like'
 WHEN label = 'manipulated' AND social = 'none' AND variant LIKE 'injection%' THEN 'attacked: injection' WHEN label = 'manipulated' AND social = 'none' THEN 'attacked: other' WHEN label = 'manipulated' THEN 'attacked: platform-like' WHEN label = 'synthetic' AND contains(variant, '+inj') THEN 'synthetic: injected' WHEN label = 'synthetic' AND social = 'none' THEN 'synthetic: plain' WHEN label = 'synthetic' THEN 'synthetic: platform-like' ELSE 'other' END AS kind,
 count(*) AS n, round(avg((y = pred)::INT), 6) AS right FROM s GROUP BY ALL""".replace("AS right", 'AS "right"'),
    "spoof_acceptance": f"WITH {SCORED} SELECT model, alpha, count(*) AS n, round(avg((pred = 0)::INT), 6) AS accepted FROM s WHERE contains(variant, 'inj') AND alpha IS NOT NULL AND NOT isnan(alpha) GROUP BY ALL",
    "pivot_correct": f"WITH {SCORED} SELECT model, {', '.join(f'round(avg((y = pred)::INT) FILTER (label = {c!r}), 6) AS {c}' for c in E.CLASSES)} FROM s GROUP BY ALL",
    "same_clips_compare": f"WITH {SCORED}, b AS (SELECT split_name, sample_id, max((y = pred)::INT) FILTER (model = 'svm') AS svm, max((y = pred)::INT) FILTER (model = 'xgb') AS xgb FROM s WHERE model IN ('svm', 'xgb') AND part = 'test' GROUP BY ALL HAVING svm IS NOT NULL AND xgb IS NOT NULL) SELECT split_name, count(*) AS n, round(avg(svm), 6) AS svm, round(avg(xgb), 6) AS xgb, round(avg(xgb - svm), 6) AS change FROM b GROUP BY ALL",
    "id_intersection": "SELECT split_name, sample_id FROM predictions WHERE model = 'svm' INTERSECT SELECT split_name, sample_id FROM predictions WHERE model = 'xgb'",
    "id_difference": "SELECT split_name, sample_id FROM predictions WHERE model = 'xgb' EXCEPT SELECT split_name, sample_id FROM predictions WHERE model = 'svm'",
    "id_in_all_runs": "SELECT split_name, sample_id FROM predictions WHERE model IN ('svm', 'xgb', 'gru') GROUP BY ALL HAVING count(DISTINCT model) = 3",
    "adaptive_grid_best": f"WITH {SCORED}, g AS (SELECT sample_id, i / 10.0::DOUBLE AS t, bool_or(p_organic >= i / 10.0::DOUBLE) AS a FROM s, range(3, 10) u(i) WHERE label <> 'organic' GROUP BY ALL) SELECT t, count(*) AS n, round(avg(a::INT), 6) AS evaded FROM g GROUP BY ALL",
    "wilson_ci": f"""WITH {SCORED}, c AS (SELECT model, count(*)::DOUBLE AS n, count(*) FILTER (y = pred)::DOUBLE AS k FROM s GROUP BY ALL), w AS (SELECT *, k / n AS p, 1.96::DOUBLE AS z FROM c)
 SELECT model, n::BIGINT AS n, round(p, 6) AS acc, round((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) AS high FROM w""",
}
