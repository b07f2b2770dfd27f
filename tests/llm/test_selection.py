"""p1, p2 and p3 against a plain reading of TESTDATA.md's definitions, and their operators on hard cases."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from provenance.llm import components, cutoff, topn

SF = "/root/testdata/sf0.001"


def rows(name, sf=SF):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def found(spark, query, sf=SF):
    out = [tuple(r) for r in entry.queries()[query](spark, sf).collect()]
    assert len(out) == len(set(map(str, out)))
    return out


def plain(s):
    return re.sub(r"[\W_]", "", (s or "").lower())


def test_p1(spark):
    by = defaultdict(dict)
    for r in rows("predictions"):
        if r["model"] is not None and r["p_organic"] is not None and 0 <= r["p_organic"] <= 1:
            by[r["model"]][r["split_name"], r["sample_id"]] = r["p_organic"]
    want, sizes = set(), {}
    for t in rows("keep_targets"):
        ps = sorted(by[t["model"]].values(), reverse=True)
        if ps:
            cut = ps[max(1, math.ceil(Fraction(t["keep_permille"] * len(ps), 1000))) - 1]
            kept = {(t["model"], *k) for k, p in by[t["model"]].items() if p >= cut}
            sizes[t["model"]] = cut, len(kept)
            want |= kept
    assert want and set(found(spark, "p1_found")) == want
    assert {r.model: (r.cutoff, r.n_kept) for r in entry.queries()["p1_report"](spark, SF).collect()} == sizes


@pytest.mark.parametrize("accuracy, most", [(2000, 1_000_000), (20, 10)])
def test_cutoffs_of_ties_hot_groups_and_narrowed_brackets(spark, accuracy, most):
    rng = random.Random(3)
    data = [("hot", i, rng.random(), "x") for i in range(5000)] + [("tied", i, 0.5, None) for i in range(300)] + [("few", i, i / 10, "") for i in range(3)]
    data += [("stepped", i, rng.choice([0.1, 0.2, 0.9]), "") for i in range(700)] + [(None, 1, 0.5, ""), ("nan", 1, float("nan"), ""), ("null", 1, None, "")]
    data += [("zero", i, -0.0, "") for i in range(5)] + [("few", 0, 0.0, "")]
    # names that the function also uses inside
    df = spark.createDataFrame(data, "lo string, n int, hi double, share string")
    permille = {"hot": 333, "tied": 1, "few": 1000, "stepped": 40, "nan": 5, "zero": 0}
    targets = spark.createDataFrame([*permille.items(), ("few", 1), (None, 3), ("hot", None)], "lo string, v int")
    scored = cutoff.scored_once(df, "lo", ["n"], "hi", 0.0, 1.0)
    kept, report = cutoff.keep_fraction(scored, "lo", "hi", targets, "v", accuracy, most)
    got = Counter(r[0] for r in kept.collect())
    by = defaultdict(dict)
    for g, i, p, _ in data:
        if g in permille and p is not None and p == p:
            by[g][i] = p
    for g, xs in by.items():
        ps = sorted(xs.values(), reverse=True)
        cut = ps[max(1, math.ceil(Fraction(permille[g] * len(ps), 1000))) - 1]
        assert got[g] == sum(p >= cut for p in ps), g
    assert set(got) == set(by) and kept.columns == ["lo", "n", "hi"]
    assert {r[0]: r.n_kept for r in report.collect()} == got


def test_cutoffs_of_nothing(spark):
    empty = spark.createDataFrame([], "m string, k int, p double")
    kept, report = cutoff.keep_fraction(cutoff.scored_once(empty, "m", ["k"], "p", 0.0, 1.0), "m", "p", spark.createDataFrame([("a", 5)], "m string, t int"), "t")
    assert kept.count() == 0 and report.count() == 0


def test_p2(spark):
    sets = [({plain(x) for x in [r["model_group"], *re.split("[,; ]+", r["devices"] or "")]} - {""}, {r["fold"]} - {None}) for r in rows("model_splits")]
    while True:
        for i, (names, folds) in enumerate(sets):
            if hit := [s for s in sets[i + 1 :] if s[0] & names]:
                sets = [s for s in sets if s not in hit]
                for s in hit:
                    names |= s[0]
                    folds |= s[1]
                break
        else:
            break
    at = {n: f for names, f in sets for n in names}
    want = {(r["row_id"],) for r in rows("videos") if (f := at.get(plain(r["device"] if r["device"] is not None else r["model_group"]))) and r["fold"] is not None and {r["fold"]} != f}
    assert want and set(found(spark, "p2_found")) == want


def test_p2_splits(spark):
    sf = "/root/testdata/sf0.01"
    out = {r.row_id: (r.split, r.component) for r in entry.queries()["p2_splits"](spark, sf).collect()}
    split, at, videos = {k: v[0] for k, v in out.items()}, {}, rows("videos", sf)
    assert set(split) == {r["row_id"] for r in videos}
    for r in videos:
        for c in ("device", "model_group"):
            if plain(r[c]):
                assert at.setdefault(plain(r[c]), split[r["row_id"]]) == split[r["row_id"]]
    for r in rows("model_splits", sf):
        names = {plain(x) for x in [r["model_group"], *re.split("[,; ]+", r["devices"] or "")]} - {""}
        assert len({at[n] for n in names if n in at}) <= 1
    n = Counter(split.values())
    assert all(abs(n[k] / len(split) - x) < 0.03 for k, x in {"train": 0.6, "val": 0.2, "test": 0.2}.items())


def test_hash_to_min_on_paths_stars_and_repeats(spark):
    rng = random.Random(5)
    edges = [(f"p{i}", f"p{i + 1}") for i in range(40)] + [("hub", f"s{i:03}") for i in range(300)] + [("a", "a"), ("b", "c"), ("b", "c"), (None, "x"), ("y", None)]
    edges += [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(50)]
    rng.shuffle(edges)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a and b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    out = components.hash_to_min(spark.createDataFrame(edges, "v string, u string"), "v", "u").collect()
    assert {r.node: r.component for r in out} == {x: find(x) for x in root} and len(out) == len(root)
    assert components.hash_to_min(spark.createDataFrame([], "v string, u string"), "v", "u").count() == 0


def test_rendezvous_meets_shares_and_moves_little(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("c"))
    three, four = {"a": 0.6, "b": 0.2, "c": 0.2}, {"a": 0.6, "b": 0.2, "c": 0.2, "d": 0.25}
    r = df.select(components.rendezvous(df.c, three, 1).alias("x"), components.rendezvous(df.c, four, 1).alias("y")).collect()
    n = Counter(x.x for x in r)
    assert all(abs(n[k] / 20_000 - w) < 0.015 for k, w in three.items())
    assert all(x.x == x.y or x.y == "d" for x in r)


def test_p3(spark):
    best = defaultdict(dict)
    for r in rows("scores"):
        if r["pce0"] is not None and r["pce0"] == r["pce0"]:
            best[r["query"]][r["candidate"]] = max(r["pce0"], best[r["query"]].get(r["candidate"], -math.inf))
    want = {(q, c) for q, x in best.items() for c in sorted(x, key=lambda c: (-x[c], c.encode()))[:3]}
    assert want and set(found(spark, "p3_found")) == want
    assert {(q, c) for q, c, *_ in found(spark, "p3_ranked")} == want


def test_first_n_over_batch_borders():
    data = [("a", "x"), ("a", "x"), ("a", "y"), ("a", "x"), ("a", "z"), ("b", "x"), ("c", "q"), ("c", "q"), ("c", "r")]
    for size in (1, 2, 3, 9):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in data[i : i + size]]) for k in (0, 1)], ["g", "i"]) for i in range(0, len(data), size)]
        batches.insert(1, batches[0].slice(0, 0))
        out = [tuple(r.values()) for b in topn.first_n(iter(batches), 2) for r in b.to_pylist()]
        assert out == [("a", "x"), ("a", "y"), ("b", "x"), ("c", "q"), ("c", "r")]


def test_top_n_hard_cases(spark):
    rng = random.Random(7)
    data = [("hot", f"c{rng.randrange(900)}", float(rng.randrange(40)), 1) for _ in range(6000)] + [("é", "b", 1.0, 1), ("é", "a", 1.0, 1), ("", "", -math.inf, 1)]
    data += [("n", None, 1.0, 1), (None, "x", 1.0, 1), ("n", "y", None, 1), ("n", "z", float("nan"), 1), ("zero", "b", 0.0, 1), ("zero", "a", -0.0, 1)]
    df = spark.createDataFrame(data, "s string, g string, i double, rank int").repartition(7)
    out = topn.top_n(df, "s", "g", "i", 3).collect()
    best = defaultdict(dict)
    for q, c, p, _ in data:
        if q is not None and c is not None and p is not None and p == p:
            best[q][c] = max(p, best[q].get(c, -math.inf))
    want = {(q, c, x[c], k + 1) for q, x in best.items() for k, c in enumerate(sorted(x, key=lambda c: (-x[c], c.encode()))[:3])}
    assert {tuple(r) for r in out} == want and len(out) == len(want)
    assert topn.top_n(df.limit(0), "s", "g", "i", 3).count() == 0
