"""Queries of attribution over scores, of banks over embeddings, and of frame windows over events and lineitem (stand-ins for per-frame features)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bank as B
from ..operators import evaluation as E
from ..operators import frames as V
from ..operators import relational as R
from ..operators import weights as W
from ..sources.tables import table
from .evaluation import _ROC, AUC, EER, r6

LIMIT = 60.0


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (query, candidate): the one with the highest pce0, then pce and ncc; null and NaN pce0 are out."""
    s = table(spark, sf_dir, "scores").where(F.col("pce0").isNotNull() & ~F.isnan("pce0"))
    best = F.max(F.struct("pce0", "pce", "ncc")).alias("m")
    return s.groupBy("query", "candidate").agg(best, F.min("device").alias("device"), F.min("version").alias("version"), F.min("split").alias("split"), F.bool_or("stabilized").alias("stabilized"), F.bool_or("is_match").alias("is_match")).select("query", "candidate", "m.*", "device", "version", "split", "stabilized", "is_match")


PAIRS = """x AS (SELECT query, candidate, max(row(pce0, pce, ncc)) AS m, min(device) AS device, min(version) AS version, min(split) AS split, bool_or(stabilized) AS stabilized, bool_or(is_match) AS is_match FROM scores WHERE pce0 IS NOT NULL AND NOT isnan(pce0) GROUP BY ALL),
 p AS (SELECT query, candidate, m[1] AS pce0, m[2] AS pce, m[3] AS ncc, device, version, split, stabilized, is_match FROM x)"""


def claimed_vs_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query: the score of its own device, the best other device by pce0 (first in byte order of equals), and the greatest ncc of any other, which may be another's."""
    p = pairs(spark, sf_dir)
    own, other = F.col("candidate") == F.col("device"), F.col("candidate") != F.col("device")
    best = F.min_by(F.when(other, F.struct("candidate", "pce0")), F.when(other, F.struct(-F.col("pce0"), F.col("candidate"))))
    return p.groupBy("query").agg(F.max(F.when(own, F.col("pce0"))).alias("claimed"), best.alias("b"), F.max(F.when(other, F.col("ncc"))).alias("ncc_max_other")).select("query", "claimed", F.col("b.candidate").alias("max_other_device"), F.col("b.pce0").alias("max_other"), "ncc_max_other")


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-set accuracy, rates at the threshold and AUC and EER of pce0, by version and stabilisation."""
    by = ["version", "stabilized"]
    p = pairs(spark, sf_dir)
    top = p.groupBy(*by, "query").agg(F.min_by(F.col("candidate") == F.col("device"), F.struct(-F.col("pce0"), F.col("candidate"))).alias("hit"))
    acc = top.groupBy(*by).agg(F.count("*").alias("n_queries"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("acc"))
    above = (F.col("pce0") > LIMIT).cast("double")
    rates = p.groupBy(*by).agg(F.round(F.avg(F.when(F.col("is_match"), above)), 6).alias("tpr60"), F.round(F.avg(F.when(~F.col("is_match"), above)), 6).alias("fpr60"))
    curve = E.roc(p, by, F.col("is_match"), F.col("pce0"))
    out = acc.join(rates, by).join(E.auc(curve, by).select(*by, F.round("auc", 6).alias("auc_pce0")), by)
    ncc = E.auc(E.roc(p, by, F.col("is_match"), F.col("ncc")), by).select(*by, F.round("auc", 6).alias("auc_ncc"))
    return out.join(ncc, by).join(E.eer(curve, by).select(*by, F.round("eer", 6).alias("eer_pce0")), by, "left")


def usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices that are found first in half of their queries or more."""
    p = pairs(spark, sf_dir).where("device is not null")
    top = p.groupBy("device", "query").agg(F.min_by(F.col("candidate") == F.col("device"), F.struct(-F.col("pce0"), F.col("candidate"))).alias("hit"))
    return top.groupBy("device").agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("rate")).where("rate >= 0.5").select("device", "n", *r6("rate"))


def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and second candidate of each query and the gap between."""
    p = pairs(spark, sf_dir)
    two = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("pce0")).alias("o"), "candidate"))), 1, 2)
    # per query as many entries as candidates, which the registry bounds
    t = p.groupBy("query").agg(two.alias("t"))
    return t.select("query", F.get("t", F.lit(0))["candidate"].alias("best"), F.get("t", F.lit(1))["candidate"].alias("second"), F.round(F.get("t", F.lit(1))["o"] - F.get("t", F.lit(0))["o"], 6).alias("margin"))


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every matching pair beside the median of up to 10 native matching pairs of its device, other contents only."""
    p = pairs(spark, sf_dir).where("is_match and device is not null").withColumn("content", F.split("query", "__")[0])
    c = W.calibrated(p.select("query", "device", "content", "pce0", "ncc"), p.where("version = 'native'"), "device", "content", ["pce0", "ncc"], 10)
    return c.select("query", "device", *r6("cal_pce0", "cal_ncc"), F.round(F.col("pce0") - F.col("cal_pce0"), 6).alias("dev_pce0"))


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of taking the best candidate where its pce0 is above a threshold, per threshold of a grid, on validation queries; the first best is marked.

    Queries are counted per threshold step, so the grid meets counts, not rows.
    """
    p = pairs(spark, sf_dir).where("split = 'val'")
    top = p.groupBy("query").agg(F.min_by(F.struct((F.col("candidate") == F.col("device")).alias("hit"), "pce0"), F.struct(-F.col("pce0"), F.col("candidate"))).alias("b")).select("query", "b.*")
    grid = [float(x) for x in range(0, 101, 5)]
    passed = sum(F.when(F.col("pce0") > t, 1).otherwise(0) for t in grid)
    cells = top.groupBy(passed.alias("k")).agg(F.count("*").alias("n"), F.count_if("hit").alias("h"))
    long = cells.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))))
    out = long.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("k") > F.col("i"), F.col("h")).otherwise(0)).alias("hits"), F.sum(F.when(F.col("k") > F.col("i"), F.col("n")).otherwise(0)).alias("decided"))
    return out.select((F.col("i") * 5.0).alias("threshold"), "n", "decided", "hits")


def fusion_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pair: signed log of pce0 and whether it is the query's first."""
    p = pairs(spark, sf_dir)
    top = p.groupBy("query").agg(F.min_by("candidate", F.struct(-F.col("pce0"), F.col("candidate"))).alias("top"))
    return p.join(top, "query").select("query", "candidate", F.round(V.slog(F.col("pce0")), 6).alias("slog_pce0"), (F.col("candidate") == F.col("top")).alias("is_top"))


DIMS = 64


def _parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("label is not null")
    return R.numbered(e, ["label"], [F.asc("vec_id")])


def bank_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = B.reference_means(_parted(spark, sf_dir).where("n < 5"), "label", "embedding", DIMS)
    return k.select("label", F.posexplode("k").alias("i", "x")).select("label", "i", *r6("x"))


def bank_ncc(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _parted(spark, sf_dir)
    bank = B.reference_means(e.where("n < 5"), "label", "embedding", DIMS).withColumnRenamed("label", "candidate")
    return B.bank_scores(e.where("n >= 5").select("vec_id", "embedding"), bank, "embedding", "k").select("vec_id", "candidate", *r6("ncc"))


def bank_pce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The PCE of every query vector against its own label's mean, over all 64 shifts."""
    e = _parted(spark, sf_dir)
    bank = B.reference_means(e.where("n < 5"), "label", "embedding", DIMS)
    q = e.where("n >= 5").join(bank, "label")
    corr = B.circular_correlation(B.centred(F.col("embedding")), B.centred(F.col("k")), DIMS)
    return q.withColumn("corr", corr).select("vec_id", F.round(B.pce(F.col("corr"), DIMS), 4).alias("pce0"))


def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a correlation of 0.9 or more."""
    return B.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", DIMS, 0.9).select("a", "b", *r6("similarity"))


def near_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups that these pairs tie together, copies with their first one; a vector of no pair is a group of its own."""
    e = B.copies(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    groups = B.components(near_pairs(spark, sf_dir), "a", "b")
    return e.join(groups, F.col("first") == F.col("item"), "left").select("vec_id", F.coalesce("group", "first").alias("group"))


def _event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.numbered_frames(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])


def _line_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.numbered_frames(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_shipdate", "l_partkey"])


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.window_features(_event_frames(spark, sf_dir).withColumnRenamed("value", "pce"), "user_id", ["pce"], 5)
    return V.slog_columns(f, "pce").select("user_id", "n_frames", *r6("pce_mean", "pce_std", "pce_min"))


def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _line_frames(spark, sf_dir)
    v = ["l_quantity", "l_extendedprice"]
    w5, w10 = (V.window_features(f, "l_orderkey", v, w, f"w{w}_") for w in (5, 10))
    cols = [f"w{w}_{x}_{s}" for w in (5, 10) for x in v for s in ("mean", "std", "min")]
    return w5.join(w10, "l_orderkey").select("l_orderkey", *(F.round(F.col(c) + 1e-7, 4).alias(c) for c in cols))


def lag_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.lagged(_event_frames(spark, sf_dir), "user_id", "value")
    return f.groupBy("user_id").agg(F.round(F.avg(F.col("value") * F.col("prev")), 4).alias("lag1"), F.count("prev").alias("n"), F.round(F.corr("value", "prev"), 6).alias("r"))


def prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.prefix_sums(_event_frames(spark, sf_dir), "user_id", "value", [5, 10]).select("user_id", *(F.round(c, 4).alias(c) for c in ("sum_5", "sum_10")))


def pads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.padded(_line_frames(spark, sf_dir), "l_orderkey", "l_partkey", 5)
    return p.select("l_orderkey", "n", F.array_join(F.transform("xs", lambda x: x.cast("string")), ",").alias("xs"))


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _event_frames(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.array_join(F.transform(V.even_picks(F.col("n"), 4), lambda x: x.cast("string")), ",").alias("picks"))


def strides(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _event_frames(spark, sf_dir)
    n = f.groupBy("user_id").agg(F.count("*").alias("n"))
    return f.join(n, "user_id").where(F.col("frame") % V.stride(F.col("n"), 3) == 0).select("event_id", "frame")


QUERIES = {
    "claimed_vs_max_other": claimed_vs_other, "attribution_summary": attribution, "usable_devices": usable, "assignment_margin": margins, "camera_calibration": calibrated,
    "hybrid_threshold_search": hybrid, "camera_fusion_features": fusion_features,
    "bank_reference_mean": bank_means, "bank_scores_ncc": bank_ncc, "circular_pce0": bank_pce, "near_duplicate_pairs": near_pairs, "near_duplicate_groups": near_groups,
    "window_features_events": event_windows, "window_features_orders": line_windows, "frame_lag_correlation": lag_products, "prefix_accumulators": prefixes, "cyclic_pad": pads, "even_frame_pick": picks, "stride_pick": strides,
}

_TOP = "t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pce0 DESC, candidate) AS rn FROM p)"
_EV = "f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events)"
_LI = "f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey) - 1 AS frame FROM lineitem)"
_BANK = "e AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings WHERE label IS NOT NULL), l AS (SELECT label, vec_id, n, i, embedding[i + 1]::DOUBLE AS x FROM e, range(64) u(i)), b AS (SELECT label, i, avg(x) AS x FROM l WHERE n < 5 GROUP BY ALL)"
_S = "sign({x}) * ln(1 + abs({x}))"
SQL = {
    "claimed_vs_max_other": f"WITH {PAIRS} SELECT query, max(pce0) FILTER (candidate = device) AS claimed, arg_min(candidate, row(-pce0, candidate)) FILTER (candidate <> device) AS max_other_device, max(pce0) FILTER (candidate <> device) AS max_other, max(ncc) FILTER (candidate <> device) AS ncc_max_other FROM p GROUP BY ALL",
    "attribution_summary": f"""WITH {PAIRS}, {_TOP}, a AS (SELECT version, stabilized, count(*) AS n_queries, round(avg((candidate = device)::INT), 6) AS acc FROM t WHERE rn = 1 GROUP BY ALL),
 g AS (SELECT version, stabilized, round(avg((pce0 > 60)::INT) FILTER (is_match), 6) AS tpr60, round(avg((pce0 > 60)::INT) FILTER (NOT is_match), 6) AS fpr60 FROM p GROUP BY ALL), d AS (SELECT version, stabilized, pce0 AS score, is_match AS pos FROM p){_ROC.format(by="version, stabilized")},
 ra AS (SELECT version, stabilized, {AUC} AS auc_pce0 FROM r GROUP BY ALL), d2 AS (SELECT version, stabilized, ncc AS score, is_match AS pos FROM p){_ROC.format(by="version, stabilized").replace(" c AS", " c2 AS").replace("FROM d ", "FROM d2 ").replace(" r AS", " r2 AS").replace("FROM c WINDOW", "FROM c2 WINDOW")},
 na AS (SELECT version, stabilized, {AUC} AS auc_ncc FROM r2 GROUP BY ALL), ee AS ({"WITH " + EER.format(by="version, stabilized")[2:].strip()})
 SELECT * FROM a JOIN g USING (version, stabilized) JOIN ra USING (version, stabilized) JOIN na USING (version, stabilized) LEFT JOIN (SELECT version, stabilized, eer AS eer_pce0 FROM ee) USING (version, stabilized)""",
    "usable_devices": f"WITH {PAIRS}, {_TOP} SELECT device, count(*) AS n, round(avg((candidate = device)::INT), 6) AS rate FROM t WHERE rn = 1 AND device IS NOT NULL GROUP BY device HAVING avg((candidate = device)::INT) >= 0.5",
    "assignment_margin": f"WITH {PAIRS}, {_TOP} SELECT query, max(candidate) FILTER (rn = 1) AS best, max(candidate) FILTER (rn = 2) AS second, round(max(pce0) FILTER (rn = 1) - max(pce0) FILTER (rn = 2), 6) AS margin FROM t GROUP BY ALL",
    "camera_calibration": f"""WITH {PAIRS}, m AS (SELECT *, split_part(query, '__', 1) AS content FROM p WHERE is_match AND device IS NOT NULL), o AS (SELECT device, content, avg(pce0) AS pce0, avg(ncc) AS ncc FROM m WHERE version = 'native' GROUP BY ALL),
 k AS (SELECT m.query, o.pce0, o.ncc, row_number() OVER (PARTITION BY m.query ORDER BY md5('0|' || o.content), o.content) AS rn FROM m JOIN o ON m.device = o.device AND m.content <> o.content), g AS (SELECT query, median(pce0) AS cp, median(ncc) AS cn FROM k WHERE rn <= 10 GROUP BY ALL)
 SELECT m.query, device, round(cp, 6) AS cal_pce0, round(cn, 6) AS cal_ncc, round(pce0 - cp, 6) AS dev_pce0 FROM m LEFT JOIN g USING (query)""",
    "hybrid_threshold_search": f"WITH {PAIRS}, {_TOP} SELECT i * 5.0::DOUBLE AS threshold, count(*) AS n, count(*) FILTER (pce0 > i * 5) AS decided, count(*) FILTER (pce0 > i * 5 AND candidate = device) AS hits FROM t, range(21) u(i) WHERE rn = 1 AND split = 'val' GROUP BY ALL",
    "camera_fusion_features": f"WITH {PAIRS}, {_TOP} SELECT query, candidate, round({_S.format(x='pce0')}, 6) AS slog_pce0, rn = 1 AS is_top FROM t",
    "bank_reference_mean": f"WITH {_BANK} SELECT label, i::INT AS i, round(x, 6) AS x FROM b",
    "bank_scores_ncc": f"""WITH {_BANK}, cb AS (SELECT label, i, x - avg(x) OVER (PARTITION BY label) AS x FROM b), cq AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM l WHERE n >= 5)
 SELECT vec_id, label AS candidate, round(sum(cq.x * cb.x) / (sqrt(sum(cq.x * cq.x)) * sqrt(sum(cb.x * cb.x))), 6) AS ncc FROM cq JOIN cb USING (i) GROUP BY ALL""",
    "circular_pce0": f"""WITH {_BANK}, cb AS (SELECT label, i, x - avg(x) OVER (PARTITION BY label) AS x FROM b), cq AS (SELECT label, vec_id, i, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM l WHERE n >= 5),
 c AS (SELECT vec_id, s, sum(cq.x * cb.x) AS c FROM cq, range(64) u(s), cb WHERE cb.label = cq.label AND cb.i = (cq.i + s) % 64 GROUP BY ALL)
 SELECT vec_id, round(sign(max(c) FILTER (s = 0)) * (max(c) FILTER (s = 0)) ** 2 / greatest(avg(c * c) FILTER (s BETWEEN 3 AND 61), 1e-12), 4) AS pce0 FROM c GROUP BY ALL""",
    "window_features_events": f"WITH {_EV}, g AS (SELECT user_id, count(*) AS n_frames, avg(value) AS a, stddev_samp(value) AS b, min(value) AS c FROM f WHERE frame < 5 GROUP BY ALL) SELECT user_id, n_frames, round({_S.format(x='a')}, 6) AS pce_mean, round({_S.format(x='b')}, 6) AS pce_std, round({_S.format(x='c')}, 6) AS pce_min FROM g",
    "window_features_orders": f"WITH {_LI} SELECT l_orderkey, {', '.join(f'round({fn}({x}) FILTER (frame < {w}) + 1e-7, 4) AS w{w}_{x}_{s}' for w in (5, 10) for x in ('l_quantity', 'l_extendedprice') for s, fn in (('mean', 'avg'), ('std', 'stddev_samp'), ('min', 'min')))} FROM f GROUP BY ALL",
    "frame_lag_correlation": f"WITH {_EV}, g AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY frame) AS prev FROM f) SELECT user_id, round(avg(value * prev), 4) AS lag1, count(prev) AS n, round(corr(value, prev), 6) AS r FROM g GROUP BY ALL",
    "prefix_accumulators": f"WITH {_EV} SELECT user_id, round(sum(value) FILTER (frame < 5), 4) AS sum_5, round(sum(value) FILTER (frame < 10), 4) AS sum_10 FROM f GROUP BY ALL",
    "cyclic_pad": f"WITH {_LI}, g AS (SELECT l_orderkey, list(l_partkey ORDER BY frame) AS s FROM f WHERE frame < 5 GROUP BY ALL) SELECT l_orderkey, len(s)::INT AS n, array_to_string(list_transform(range(5), lambda i: s[(i % len(s)) + 1]), ',') AS xs FROM g",
    "even_frame_pick": f"WITH g AS (SELECT user_id, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, array_to_string(list_sort(list_distinct(list_transform(range(4), lambda i: floor(i * (n - 1) / 3.0::DOUBLE)::INT))), ',') AS picks FROM g",
    "stride_pick": f"WITH {_EV}, g AS (SELECT user_id, count(*) AS n FROM events GROUP BY ALL) SELECT event_id, frame::INT AS frame FROM f JOIN g USING (user_id) WHERE frame % greatest(1, n // 3) = 0",
}
