"""p4 and p5 against a plain reading of TESTDATA.md's definitions, and their operators on hard cases."""

import math
import posixpath
import re
from collections import Counter, defaultdict
from datetime import datetime
from fractions import Fraction

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from provenance.functions import names
from provenance.operators import profile as P
from provenance.operators import references as R

SF = "/root/testdata/sf0.001"


def rows(name, sf=SF):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def found(spark, query, sf=SF):
    out = [tuple(r) for r in entry.queries()[query](spark, sf).collect()]
    assert len(out) == len(set(map(str, out)))
    return out


def plain(s):
    return re.sub(r"[\W_]", "", (s or "").lower())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_p4(spark):
    bad = {"fps": lambda x: not 1 <= x <= 240, "width": lambda x: not 16 <= x <= 8192, "codec": lambda x: not re.fullmatch("[a-z][a-z0-9]{2,9}", x)}
    sf = "/root/testdata/sf0.01"
    by = defaultdict(list)
    for r in rows("inventory", sf):
        by[r["load_id"]].append(r)
    want = set()
    for r in rows("loads", sf):
        for c in bad:

            def of(load):
                xs = [x[c] for x in by[load]]
                good = [math.floor(x + 0.5) if c == "fps" else x for x in xs if x is not None and not bad[c](x)]
                return Fraction(xs.count(None), len(xs)), {k: Fraction(n, len(good)) for k, n in Counter(good).items()}

            if any(x[c] is not None and bad[c](x[c]) for x in by[r["load_id"]]):
                want.add((r["load_id"], c, "value"))
            if r["base_load_id"] is not None:
                (n, m), (n0, m0) = of(r["load_id"]), of(r["base_load_id"])
                if abs(n - n0) > Fraction(1, 10):
                    want.add((r["load_id"], c, "nulls"))
                if sum(abs(m.get(k, 0) - m0.get(k, 0)) for k in {*m, *m0}) / 2 > Fraction(3, 10):
                    want.add((r["load_id"], c, "mix"))
    assert {f for *_, f in want} == {"value", "nulls", "mix"} and set(found(spark, "p4_found", sf)) == want


def test_profile_power_sums_are_exact_and_merge(spark):
    import numpy as np

    xs = [0.1, 0.1, 2.5, float("nan"), None, 1e17, -3.0] * 3
    df = spark.createDataFrame([(1, x) for x in xs] + [(2, None)], "load int, a double")
    counts = P.value_counts(df, "load", {"a": P.Rule(lambda c: F.isnan(c) | (c > 1e6), 1)})
    r = {x.load: x for x in P.moments(P.profile(counts, "load"), {"a": 1}).collect()}
    units = [1, 1, 25, -30] * 3
    assert [int(r[1][f"s{k}"]) for k in (1, 2, 3, 4)] == [sum(u**k for u in units) for k in (1, 2, 3, 4)]
    assert (r[1].rows, r[1].nulls, r[1].bads, r[1].goods, r[1].n_distinct, int(r[1].least), int(r[1].most)) == (21, 3, 6, 12, 5, -30, 25)
    a = np.array(units) / 10
    assert math.isclose(r[1]["mean"], a.mean()) and math.isclose(r[1].sd, a.std()) and math.isclose(r[1].skewness, ((a - a.mean()) ** 3).mean() / a.std() ** 3)
    assert (r[2].nulls, r[2].n_distinct, r[2].s1, r[2]["mean"]) == (1, 0, None, None)


def test_profile_hard_cases(spark):
    wide = spark.createDataFrame([(1, "", [1], "x" * 100_000), (1, None, None, None), (None, "a", [2], "b")], "load int, `a.b` string, `value` array<int>, n string")
    out = {x.column_name: x for x in P.profile(P.value_counts(wide, "load", {c: P.Rule() for c in ("a.b", "value", "n")}), "load").collect()}
    assert {c: (x.rows, x.nulls, x.n_distinct) for c, x in out.items()} == {"a.b": (2, 1, 1), "value": (2, 1, 1), "n": (2, 1, 1)}
    assert P.profile(P.value_counts(wide.limit(0), "load", {"n": P.Rule()}), "load").count() == 0
    with pytest.raises(ValueError):
        P.value_counts(wide.withColumnRenamed("load", "value2"), "n", {})


def test_shifts(spark):
    df = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3)] + [(2, float(x)) for x in (2, 3, 4)] + [(3, 5.0)], "load int, a double")
    m = P.moments(P.profile(P.value_counts(df, "load", {"a": P.Rule()}), "load"), {"a": 3})
    bases = spark.createDataFrame([(2, 1), (3, 9)], "load int, base int")
    (r,) = P.shifts(P.with_base(m, bases, "load", ["mean", "sd"])).collect()
    assert r.load == 2 and math.isclose(r.d_mean, 1 / math.sqrt(2 / 3)) and abs(r.log_sd_ratio) < 1e-12


def test_p5(spark):
    def held(table, value, key, start, end):
        by = defaultdict(list)
        for r in rows(table):
            by[key(r[value])].append((r[start], r[end]))
        return by

    registry, files = held("camera_registry", "device", plain, "registered_at", "retired_at"), held("frame_files", "path", posixpath.normpath, "written_at", "deleted_at")
    want = set()
    for t, c, key, by in (("attacks", "claimed_device", plain, registry), ("synthetic", "claimed_device", plain, registry), ("frames_index", "frames_path", posixpath.normpath, files)):
        want |= {(t, r["row_id"]) for r in rows(t) if (r[c] or "").strip() and not any(a <= r["created_at"] and (b is None or r["created_at"] < b) for a, b in by[key(r[c])])}
    assert want and set(found(spark, "p5_found")) == want
    months = found(spark, "p5_months")
    assert Counter(t for t, _ in want) == sum((Counter({t: n}) for t, _, n in months), Counter())


def test_filter_denies_no_parent_and_few_others_pass(spark):
    parents = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    refs = spark.range(40_000).select(F.col("id").cast("string").alias("ref"), F.lit(1).alias("__x"))
    got = R.split_by_filter(refs, "ref", parents, "k").groupBy(F.col("ref").cast("long") < 20_000, "may_exist").count().collect()
    n = {(r[0], r.may_exist): r["count"] for r in got}
    assert n[True, True] == 20_000 and (True, False) not in n and n.get((False, True), 0) < 200


def test_filter_above_the_broadcast_limit_gives_the_same(spark, monkeypatch):
    args = (spark.createDataFrame([("a",), ("b",), (None,)], "ref string"), "ref", spark.createDataFrame([("a",)] * 5, "k string"), "k")
    want = sorted(map(str, R.split_by_filter(*args).collect()))
    monkeypatch.setattr(R, "BROADCAST_KEYS", 0)
    assert sorted(map(str, R.split_by_filter(*args).collect())) == want


def test_orphans_hard_cases(spark):
    t = [datetime(2024, 1, d) for d in range(1, 10)]
    refs = spark.createDataFrame([(1, "a", t[2], 0), (2, "a", t[5], 0), (3, "zz", t[2], 0), (4, None, t[2], 0), (5, "a", None, 0), (6, "", t[2], 0), (2, "a", t[5], 0)], "id int, ref string, at timestamp, k int")
    parents = spark.createDataFrame([("a", t[0], t[4]), ("a", t[0], t[4]), ("b", t[0], None), (None, t[0], None), ("zz", None, None)], "k string, since timestamp, until timestamp")
    out = R.orphans(refs, "ref", "at", parents, "k", "since", "until")
    assert out.columns == refs.columns and sorted(r.id for r in out.collect()) == [2, 2, 3, 4, 5, 6]
    assert R.orphans(refs, "ref", "at", parents.limit(0), "k", "since", "until").count() == 7
    assert R.orphans(refs.limit(0), "ref", "at", parents, "k", "since", "until").count() == 0


@pytest.mark.parametrize("path", ["a/./b//c", "./a/../b", "a/../../b", "/../a/", "../../a/..", "a/b/../../c/.", "plain/p.npy", "a/..b/.c", "/a/b", "//a", ".."])
def test_plain_path(spark, path):
    df = spark.createDataFrame([(path,)], "p string")
    want = posixpath.normpath("/" + path.lstrip("/") if path.startswith("//") else path)
    assert df.select(names.plain_path(df.p)).first()[0] == ("" if want == "." else want)
