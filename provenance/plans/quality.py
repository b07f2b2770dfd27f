"""Queries of problems 4 and 5: the data quality of inventory and the references of attacks, synthetic and frames_index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import blank, plain_path, same_name
from ..operators import profile as P
from ..operators import references as R
from ..sources.tables import table

RULES = {
    "fps": P.Rule(lambda c: F.isnan(c) | ~c.between(1.0, 240.0), 3, lambda c: F.floor(c + 0.5)),
    "width": P.Rule(lambda c: ~c.between(16, 8192)),
    "codec": P.matches("[a-z][a-z0-9]{2,9}"),
}
DIGITS = {"fps": 3, "duration_s": 3, "bitrate_kbps": 1, "size_mb": 3}


def _bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "loads").where("base_load_id is not null").select("load_id", F.col("base_load_id").alias("base")).distinct()


def load_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_found: the loads with bad values, or whose nulls or values differ from the load they are compared with.

    Shares are compared as whole numbers, so nothing hangs on rounding. Rows without load_id belong to no load.
    """
    inventory = table(spark, sf_dir, "inventory").select("load_id", *RULES)
    counts = P.value_counts(inventory, "load_id", RULES)
    profiled = P.profile(counts, "load_id")
    pairs = P.with_base(profiled, _bases(spark, sf_dir), "load_id", ["rows", "nulls", "goods"])
    nulls = pairs.where(F.abs(P.times("nulls", "base_rows") - P.times("base_nulls", "rows")) * 10 > P.times("rows", "base_rows"))
    mix = P.mix_distance(counts, pairs, "load_id").where(F.col("differ") * 10 > P.times("goods", "base_goods") * 6)
    found = ((profiled.where("bads > 0"), "value"), (nulls, "nulls"), (mix, "mix"))
    first, *rest = (df.select("load_id", "column_name", F.lit(kind).alias("finding")) for df, kind in found)
    for df in rest:
        first = first.union(df)
    return first.distinct()


def column_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_profile: every column of inventory per load."""
    inventory = table(spark, sf_dir, "inventory")
    rules = {c: RULES.get(c, P.Rule(digits=DIGITS.get(c, 0))) for c in inventory.columns if c != "load_id"}
    out = P.moments(P.profile(P.value_counts(inventory, "load_id", rules), "load_id"), DIGITS)
    return out.withColumn("null_rate", F.col("nulls") / F.col("rows"))


def column_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_shift: the standardised difference of fps and width to the load that each load is compared with."""
    inventory = table(spark, sf_dir, "inventory").select("load_id", "fps", "width")
    profiled = P.moments(P.profile(P.value_counts(inventory, "load_id", {c: RULES[c] for c in ("fps", "width")}), "load_id"), DIGITS)
    pairs = P.with_base(profiled, _bases(spark, sf_dir), "load_id", ["mean", "sd", "numbers"])
    return P.shifts(pairs).select("load_id", "base", "column_name", "numbers", "base_numbers", "mean", "base_mean", "sd", "base_sd", "d_mean", "log_sd_ratio")


def _references(spark: SparkSession, sf_dir: str, name: str, value: str) -> DataFrame:
    key = plain_path(F.col(value)) if value == "frames_path" else same_name(F.col(value))
    return table(spark, sf_dir, name).where(F.col(value).isNotNull() & ~blank(F.col(value))).select(F.lit(name).alias("table_name"), "row_id", "created_at", key.alias("ref_key"))


def unheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that name a device or path not held when they were made."""
    devices = table(spark, sf_dir, "camera_registry").select(same_name(F.col("device")).alias("k"), "registered_at", "retired_at")
    files = table(spark, sf_dir, "frame_files").select(plain_path(F.col("path")).alias("k"), "written_at", "deleted_at")
    claims = _references(spark, sf_dir, "attacks", "claimed_device").unionByName(_references(spark, sf_dir, "synthetic", "claimed_device"))
    by_device = R.orphans(claims, "ref_key", "created_at", devices, "k", "registered_at", "retired_at")
    return by_device.unionByName(R.orphans(_references(spark, sf_dir, "frames_index", "frames_path"), "ref_key", "created_at", files, "k", "written_at", "deleted_at"))


def unheld_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_found."""
    return unheld(spark, sf_dir).select("table_name", "row_id")


def unheld_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_months: the number of those rows per table and month."""
    return R.per_period(unheld(spark, sf_dir), "created_at", "table_name")


def filter_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_filter: how many references the filter of frame_files lets pass, and how many of these no file ever had."""
    files = table(spark, sf_dir, "frame_files").select(plain_path(F.col("path")).alias("k"))
    asked = R.split_by_filter(_references(spark, sf_dir, "frames_index", "frames_path"), "ref_key", files, "k")
    real = asked.where("may_exist").join(files, F.col("ref_key") == F.col("k"), "left_anti").agg(F.count("*").alias("false_positives"))
    sums = asked.agg(F.count("*").alias("refs"), F.count_if("may_exist").alias("let_pass"))
    return sums.join(F.broadcast(real))  # one row each


QUERIES = {
    "p4_found": load_findings, "p4_profile": column_profiles, "p4_shift": column_shifts,
    "p5_found": unheld_rows, "p5_filter": filter_rates, "p5_months": unheld_by_month,
}

_BAD = {"fps": "(isnan(fps) OR fps < 1 OR fps > 240)", "width": "(width < 16 OR width > 8192)", "codec": "(NOT regexp_full_match(codec, '[a-z][a-z0-9]{2,9}'))"}
_SHOWN = {"fps": "floor(fps + 0.5)::BIGINT::VARCHAR", "width": "width::VARCHAR", "codec": "codec"}
_CELLS = " UNION ALL ".join(f"SELECT load_id, '{c}' AS column_name, {c} IS NULL AS is_null, coalesce({b}, false) AS is_bad, CASE WHEN {c} IS NOT NULL AND NOT {b} THEN {_SHOWN[c]} END AS v FROM inventory WHERE load_id IS NOT NULL" for c, b in _BAD.items())
_HELD = "regexp_replace(lower(device), '[^\\p{L}\\p{M}\\p{N}]', '', 'g')"
_CLAIM = "regexp_replace(lower(claimed_device), '[^\\p{L}\\p{M}\\p{N}]', '', 'g')"


def _plain(c: str) -> str:
    """`.` and repeated slashes, then `..` four times over: as deep as any path here goes."""
    x = f"regexp_replace(regexp_replace('/' || {c}, '/(\\./)+', '/', 'g'), '/+(\\./+)*', '/', 'g')"
    for _ in range(4):
        x = f"regexp_replace({x}, '/[^/]+/\\.\\./', '/')"
    return f"ltrim({x}, '/')"


_ORPHANS = f"""o AS (SELECT 'attacks' AS table_name, row_id, created_at FROM attacks a WHERE trim(claimed_device) <> '' AND NOT EXISTS (SELECT 1 FROM camera_registry r WHERE {_HELD} = {_CLAIM} AND registered_at <= a.created_at AND (retired_at IS NULL OR a.created_at < retired_at))
 UNION ALL SELECT 'synthetic', row_id, created_at FROM synthetic a WHERE trim(claimed_device) <> '' AND NOT EXISTS (SELECT 1 FROM camera_registry r WHERE {_HELD} = {_CLAIM} AND registered_at <= a.created_at AND (retired_at IS NULL OR a.created_at < retired_at))
 UNION ALL SELECT 'frames_index', row_id, created_at FROM frames_index a WHERE trim(frames_path) <> '' AND NOT EXISTS (SELECT 1 FROM frame_files r WHERE {_plain('path')} = {_plain('frames_path')} AND written_at <= a.created_at AND (deleted_at IS NULL OR a.created_at < deleted_at)))"""
SQL = {
    "p4_found": f"""WITH c AS ({_CELLS}), t AS (SELECT load_id, column_name, count(*)::DOUBLE AS n, count(*) FILTER (is_null) AS nulls, count(*) FILTER (is_bad) AS bads, count(v)::DOUBLE AS good FROM c GROUP BY ALL),
 p AS (SELECT t.*, b.load_id AS base, b.n AS bn, b.nulls AS bnulls, b.good AS bgood FROM t JOIN loads l USING (load_id) JOIN t b ON b.load_id = l.base_load_id AND b.column_name = t.column_name), s AS (SELECT load_id, column_name, v, count(*) AS m FROM c WHERE v IS NOT NULL GROUP BY ALL),
 d AS (SELECT p.load_id, p.column_name, good, bgood, s.v, s.m * bgood AS x FROM p JOIN s USING (load_id, column_name) UNION ALL SELECT p.load_id, p.column_name, good, bgood, s.v, -s.m * good FROM p JOIN s ON s.load_id = p.base AND s.column_name = p.column_name),
 m AS (SELECT load_id, column_name, good, bgood, sum(abs(x)) AS x FROM (SELECT load_id, column_name, good, bgood, v, sum(x) AS x FROM d GROUP BY ALL) GROUP BY ALL)
 SELECT load_id, column_name, 'value' AS finding FROM t WHERE bads > 0 UNION ALL SELECT load_id, column_name, 'nulls' FROM p WHERE abs(nulls * bn - bnulls * n) * 10 > n * bn UNION ALL SELECT load_id, column_name, 'mix' FROM m WHERE good > 0 AND bgood > 0 AND x * 10 > good * bgood * 6""",
    "p4_shift": """WITH c AS (SELECT load_id, 'fps' AS column_name, rint AS x FROM (SELECT load_id, round_even(fps * 1000, 0) / 1000 AS rint FROM inventory WHERE fps BETWEEN 1 AND 240) UNION ALL SELECT load_id, 'width', width::DOUBLE FROM inventory WHERE width BETWEEN 16 AND 8192),
 m AS (SELECT load_id, column_name, count(*) AS numbers, avg(x) AS mean, stddev_pop(x) AS sd FROM c WHERE load_id IS NOT NULL GROUP BY ALL)
 SELECT a.load_id, base_load_id AS base, a.column_name, a.numbers, b.numbers AS base_numbers, a.mean, b.mean AS base_mean, a.sd, b.sd AS base_sd, (a.mean - b.mean) / sqrt((a.sd * a.sd + b.sd * b.sd) / 2) AS d_mean, ln(a.sd / b.sd) AS log_sd_ratio FROM m a JOIN loads l USING (load_id) JOIN m b ON b.load_id = l.base_load_id AND b.column_name = a.column_name""",
    "p5_found": f"WITH {_ORPHANS} SELECT table_name, row_id FROM o",
    "p5_months": f"WITH {_ORPHANS} SELECT table_name, strftime(created_at, '%Y-%m') AS month, count(*) AS n FROM o GROUP BY ALL",
}
