"""The evaluation layer against plain NumPy on small sets with ties, nulls, NaN and single-class groups."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenance.operators import decisions as D
from provenance.operators import evaluation as E
from provenance.operators import statistics as S
from provenance.operators.ordered import running

rng = random.Random(4)
ROWS = [(g, i, rng.choice([0.1, 0.2, 0.2, 0.5, 0.9]) if g != "fine" else rng.random(), rng.random() < 0.4) for g in ("ties", "fine") for i in range(120)]
ROWS += [("one class", i, rng.random(), True) for i in range(5)] + [(None, i, rng.random(), i % 2 == 0) for i in range(9)] + [("ties", 200, None, True), ("ties", 201, float("nan"), False)]


def groups():
    by = defaultdict(list)
    for g, _, s, y in ROWS:
        if s is not None and s == s:
            by[g].append((s, y))
    return by


@pytest.fixture(scope="module")
def curve(spark):
    df = spark.createDataFrame(ROWS, "g string, i int, s double, y boolean").repartition(5)
    return E.roc(df, ["g"], F.col("y"), F.col("s"))


def test_auc_counts_ties_half(curve):
    got = {r.g: r.auc for r in E.auc(curve, ["g"]).collect()}
    for g, xs in groups().items():
        p, n = [s for s, y in xs if y], [s for s, y in xs if not y]
        want = sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n)) if p and n else None
        assert got[g] == want or math.isclose(got[g], want), g


def corners(xs):
    """ROC points over distinct scores, those amid equal steps left out, as plain loops."""
    tp = fp = 0
    points = []
    for s in sorted({s for s, _ in xs}, reverse=True):
        tp += sum(y for t, y in xs if t == s)
        fp += sum(not y for t, y in xs if t == s)
        points.append((fp, tp))
    keep = [p for i, p in enumerate(points) if i in (0, len(points) - 1) or points[i - 1][0] + points[i + 1][0] != 2 * p[0] or points[i - 1][1] + points[i + 1][1] != 2 * p[1]]
    return [(0.0, 0.0)] + [(a / max(fp, 1), b / max(tp, 1)) for a, b in keep]


def test_eer_and_tpr_at(curve):
    eer = {r.g: r.eer for r in E.eer(curve, ["g"]).collect()}
    tpr = {r.g: r.tpr_at_fpr for r in E.tpr_at(curve, ["g"], 0.05).collect()}
    for g, xs in groups().items():
        if len({y for _, y in xs}) < 2:
            assert g not in eer
            continue
        pts = corners(xs)
        f, t = min(pts, key=lambda p: abs(p[0] - (1 - p[1])))
        assert math.isclose(eer[g], (f + 1 - t) / 2)
        assert math.isclose(tpr[g], np.interp(0.05, [p[0] for p in pts], [p[1] for p in pts]))


def test_running_over_one_large_group(spark):
    n = 5000
    df = spark.createDataFrame([("a", i, i % 7) for i in range(n)] + [("b", 0, None)], "g string, i int, v int").repartition(6)
    out = {(r.g, r.i): (r.upto, r.after) for r in running(df, ["g"], [F.asc("i")], {"upto": "v"}, {"after": "v"}).collect()}
    total = 0
    for i in range(n):
        total += i % 7
        assert out["a", i] == (total, (i + 1) % 7 if i + 1 < n else None)
    assert out["b", 0] == (0, None)
    assert running(df.limit(0), ["g"], [F.asc("i")], {"upto": "v"}).count() == 0


def probs(spark, n=400, classes=3):
    r = np.random.default_rng(3)
    p = r.dirichlet([1, 1, 1], n).round(3)
    y = r.integers(0, classes, n)
    rows = [("m", int(k), f"s{i}", int(i), *map(float, p[i]), E.CLASSES[y[i]]) for i in range(n) for k in [i % 2]]
    df = spark.createDataFrame(rows, "model string, split_name int, sample_id string, row_id int, p_organic double, p_manipulated double, p_synthetic double, label string")
    return E.with_scores(df), p, y


@pytest.mark.parametrize("classes", [1, 2, 3])
def test_three_macro_f1(spark, classes):
    df, p, y = probs(spark, classes=classes)
    pred = p.argmax(1)
    f = [2 * ((pred == c) & (y == c)).sum() / max(1, (pred == c).sum() + (y == c).sum()) for c in range(3)]
    c = E.class_counts(df, ["model"])
    for over, wanted in (("present", np.unique(y)), ("union", np.union1d(y, pred)), ("fixed", range(3))):
        assert math.isclose(E.macro_f1(c, "f", over).first().f, np.mean([f[k] for k in wanted]))


def test_calibration_and_risk(spark):
    df, p, y = probs(spark)
    q = p / p.sum(1, keepdims=True)
    conf, pred = q.max(1), q.argmax(1)
    idx = np.clip(np.digitize(conf, [k / 15 for k in range(1, 15)]), 0, 14)
    ece = sum((idx == b).mean() * abs((pred[idx == b] == y[idx == b]).mean() - conf[idx == b].mean()) for b in set(idx))
    r = E.calibration(E.normalised(df), ["model"]).first()
    assert math.isclose(r.ece, ece) and math.isclose(r.brier, ((q - np.eye(3)[y]) ** 2).sum(1).mean())
    u = np.round(1 - p.max(1), 9)
    order = sorted(range(len(y)), key=lambda i: (u[i], f"s{i}"))
    cum = np.cumsum([p[i].argmax() != y[i] for i in order]) / np.arange(1, len(y) + 1)
    r = E.risk_coverage(df, ["model"], F.round(1 - F.greatest(*E.P), 9), ["sample_id"], (1.0, 0.5)).first()
    assert math.isclose(r.aurc, cum.mean()) and math.isclose(r.risk_50, cum[199]) and math.isclose(r.risk_100, cum[-1])


def test_offsets_over_cells_equal_the_loop(spark):
    df, p, y = probs(spark)
    lp = np.log(np.clip(p, 1e-6, 1))
    got = {(round(r.b1, 6), round(r.b2, 6)): r.f1 for r in D.offset_f1(df, ["model"], steps=7).collect()}
    for a in range(-3, 4):
        for b in range(-3, 4):
            pred = (lp + [0, a, b]).argmax(1)
            f = np.mean([2 * ((pred == c) & (y == c)).sum() / max(1, (pred == c).sum() + (y == c).sum()) for c in range(3)])
            assert math.isclose(got[a, b], f)
    assert len(got) == 49


def test_safe_boost_and_zones(spark):
    df, p, y = probs(spark)
    lp = np.log(np.clip(p, 1e-6, 1))
    want = next((b for b in np.arange(0, 8.01, 0.05) if ((lp[y == 0] + [b + 1e-12, 0, 0]).argmax(1) == 0).mean() >= 0.95), 8.0)
    assert math.isclose(D.safe_boost(df, ["model"]).first().boost, want, abs_tol=1e-9)
    lo, hi = np.quantile(p[y == 0, 0], 0.05), max(np.quantile(p[y == c, 0], 0.95) for c in (1, 2))
    if hi < lo:
        lo = hi = (lo + hi) / 2
    r = D.zone_thresholds(df, ["model"]).first()
    assert math.isclose(r.lo, lo) and math.isclose(r.hi, hi)


def test_bootstrap_equals_explicit_resampling(spark):
    import hashlib

    rows = [(f"c{k}", rng.random() < 0.3 + 0.05 * k) for k in range(7) for _ in range(rng.randrange(3, 12))] + [(None, True)]
    df = spark.createDataFrame(rows, "cam string, ok boolean")
    per = S.cluster_sums(df, "cam", {"n": F.lit(1), "h": F.col("ok").cast("int")})
    got = {r.resample: (r.n, r.h) for r in S.resampled(per, "cam", ["n", "h"], 40).collect()}
    by = defaultdict(list)
    for c, ok in rows:
        if c:
            by[c].append(ok)
    cams = sorted(by)
    for b in range(40):
        pick = [x for j in range(len(cams)) for x in by[cams[int(hashlib.md5(f"{b}:{j}".encode()).hexdigest()[:7], 16) % len(cams)]]]
        assert got[b] == (len(pick), sum(pick))


def test_mcnemar():
    assert S.mcnemar(0, 0) == 1.0 and math.isclose(S.mcnemar(1, 9), 2 * (1 + 10) / 1024) and math.isclose(S.mcnemar(5, 5), 1.0)


def test_once_keeps_the_first_delivery(spark):
    df = spark.createDataFrame([(3, "m", None, "s", 1.0), (1, "m", None, "s", 2.0), (2, "m", "f", "s", 3.0)], "row_id int, model string, split_name string, sample_id string, v double")
    assert Counter(r.v for r in E.once(df).collect()) == Counter([2.0, 3.0])
