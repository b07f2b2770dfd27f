"""Queries of tables, joins, sets, splits and weights over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import same_name
from ..operators import relational as R
from ..operators import weights as W
from ..operators.evaluation import class_code
from ..sources.tables import table
from .evaluation import ONCE, r6

SAMPLE = {"sample_id": "string", "label": "string", "source": "string", "variant": "string", "social": "string", "alpha": "double", "device": "string", "claimed_device": "string", "split": "string", "fold": "int", "stabilized": "boolean", "frames_path": "string"}


def first_delivery(df: DataFrame) -> DataFrame:
    """Records that are equal but for row_id and ingested_at count once, under the smallest row_id."""
    same = [c for c in df.columns if c not in ("row_id", "ingested_at")]
    return df.groupBy(*same).agg(F.min("row_id").alias("row_id"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """attacks, synthetic and original videos under one pinned schema."""
    a = first_delivery(table(spark, sf_dir, "attacks")).withColumns({"sample_id": F.concat_ws("__", "content_id", "variant"), "source": F.concat("dataset", F.lit("-attack")), "alpha": F.nanvl("alpha", F.lit(None))})
    s = first_delivery(table(spark, sf_dir, "synthetic")).withColumns({"sample_id": F.col("content_id"), "source": F.col("dataset"), "variant": F.concat(F.col("generator"), F.coalesce(F.concat(F.lit("+inj"), F.nanvl("inj_alpha", F.lit(None)).cast("decimal(9,2)").cast("string")), F.lit(""))), "alpha": F.nanvl("inj_alpha", F.lit(None))})
    v = table(spark, sf_dir, "videos").where("role = 'sample'").withColumns({"sample_id": F.concat_ws("__", "content_id", "version"), "label": F.lit("organic"), "source": F.col("dataset"), "variant": F.col("version"), "social": F.when(F.col("version") == "native", "none").otherwise("real"), "claimed_device": F.col("device")})
    v = R.keep(v, ["sample_id"], "row_id")
    parts = [R.pinned(x, SAMPLE) for x in (a, s, v)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SAME_A = "content_id, dataset, variant, base_variant, social, attack, alpha, crf, label, device, claimed_device, model_group, split, fold, stabilized, victim_split, frames_path, n_saved, status, error, created_at"
_SAME_S = "content_id, dataset, generator, label, base_content_id, source_path, claimed_device, split, fold, social, inj_alpha, frames_path, width, height, fps, duration_s, codec, n_saved, status, error, created_at"
SAMPLES = f"""v AS (SELECT * FROM videos WHERE role = 'sample' QUALIFY row_number() OVER (PARTITION BY content_id, version ORDER BY row_id) = 1),
 u AS (SELECT concat_ws('__', content_id, variant) AS sample_id, label, dataset || '-attack' AS source, variant, social, CASE WHEN isnan(alpha) THEN NULL ELSE alpha END AS alpha, device, claimed_device, split, fold, stabilized, frames_path FROM (SELECT DISTINCT {_SAME_A} FROM attacks)
 UNION ALL SELECT content_id, label, dataset, generator || coalesce('+inj' || CAST(CASE WHEN isnan(inj_alpha) THEN NULL ELSE inj_alpha END AS DECIMAL(9,2))::VARCHAR, ''), social, CASE WHEN isnan(inj_alpha) THEN NULL ELSE inj_alpha END, NULL, claimed_device, split, fold, NULL, frames_path FROM (SELECT DISTINCT {_SAME_S} FROM synthetic)
 UNION ALL SELECT concat_ws('__', content_id, version), 'organic', dataset, version, CASE WHEN version = 'native' THEN 'none' ELSE 'real' END, NULL, device, device, split, fold, stabilized, NULL FROM v)"""


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "videos")


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles by the rank of a content within its device, then by later rules; the first rows of a device are its reference."""
    rank = F.dense_rank().over(Window.partitionBy("device").orderBy("content_id"))
    v = _videos(spark, sf_dir).where("device is not null and content_id is not null").withColumn("rank", rank)
    base = F.when(F.col("scene_group") == "flat", F.when(F.col("version") == "native", "reference").otherwise("reference_derived")).otherwise("sample")
    acid = F.when(F.col("rank") <= 5, "reference").when(F.col("rank") <= 20, "sample").otherwise("unused")
    role = F.when(~F.coalesce("ok", F.lit(False)) | F.coalesce("errata", F.lit(False)), "excluded").when(F.col("dataset") == "ACID", acid).otherwise(base)
    return v.select("row_id", "rank", role.alias("new_role"))


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _videos(spark, sf_dir).where("device is not null")
    return R.numbered(v, ["device"], [F.asc("content_id"), F.asc("version"), F.asc("row_id")]).select("row_id", (F.col("n") % 2).alias("half"))


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _videos(spark, sf_dir).where("device is not null")
    return R.numbered(v, ["device"], [F.asc("content_id"), F.asc("version"), F.asc("row_id")]).where("n < 3").select("device", "row_id", "n")


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.seeded_sample(_videos(spark, sf_dir), ["dataset"], "row_id", 7, 20).select("dataset", "row_id")


def latest_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keep(table(spark, sf_dir, "inventory"), ["content_id", "version"], "row_id", last=True).select("content_id", "version", "row_id", "load_id")


def first_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keep(table(spark, sf_dir, "inventory"), ["content_id", "version"], "row_id").select("content_id", "version", "row_id", "load_id")


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load 2 over load 1, the later row of a load before the earlier one."""
    inv = table(spark, sf_dir, "inventory")
    keys = ["content_id", "version"]
    one, two = (R.keep(inv.where(F.col("load_id") == k), keys, "row_id", last=True).select(*keys, "row_id", "load_id") for k in (1, 2))
    return R.merge_runs(one, two, keys)


def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load 1 with its datasets of load 2 in their place."""
    inv = table(spark, sf_dir, "inventory").select("dataset", "row_id", "load_id")
    new = inv.where("load_id = 2 and dataset = 'ACID'")
    return R.replace_part(inv.where("load_id = 1"), new, "dataset")


def reusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes of load 2 that need not be made again: load 1 has one of the same path and size that went well."""
    inv = table(spark, sf_dir, "inventory")
    old = inv.where("load_id = 1 and ok").select(F.col("path").alias("old_path"), F.col("size_mb").alias("old_mb"))
    return inv.where("load_id = 2").join(old, (F.col("path") == F.col("old_path")) & (F.abs(F.col("size_mb") - F.col("old_mb")) < 0.01), "left_semi").select("row_id")


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native videos and their copies on platforms."""
    v = _videos(spark, sf_dir)
    native = R.keep(v.where("version = 'native'"), ["content_id"], "row_id").select("content_id", F.col("row_id").alias("native_row"))
    other = v.where("version <> 'native'").select("content_id", "version", "row_id")
    return native.join(other, "content_id", "left")


def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos with the first registered brand of their device; a device of no entry stays, with null."""
    reg = table(spark, sf_dir, "camera_registry").select(same_name(F.col("device")).alias("k"), "entry_id", F.col("brand").alias("registered_brand"))
    return _videos(spark, sf_dir).select("row_id", same_name(F.col("device")).alias("k")).join(R.keep(reg, ["k"], "entry_id"), "k", "left").select("row_id", "registered_brand")


def unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames_index rows whose video stands in the split table with the same device."""
    keys = ["content_id", "version", "device"]
    return table(spark, sf_dir, "frames_index").join(_videos(spark, sf_dir).select(*keys), keys, "left_semi").select("row_id")


def to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable videos without extracted frames."""
    done = table(spark, sf_dir, "frames_index").where("status = 'ok'").select("content_id", "version")
    return _videos(spark, sf_dir).where("ok").join(done, ["content_id", "version"], "left_anti").select("row_id")


def null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attacks and synthetic by fold, null folds meeting each other."""
    a, s = (first_delivery(table(spark, sf_dir, t)).groupBy("fold").agg(F.count("*").alias(t)) for t in ("attacks", "synthetic"))
    return a.alias("a").join(s.alias("s"), F.col("a.fold").eqNullSafe(F.col("s.fold")), "full").select(F.coalesce("a.fold", "s.fold").alias("fold"), "attacks", "synthetic")


def null_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by model with and without the null one, side by side."""
    g = table(spark, sf_dir, "predictions").groupBy("model").agg(F.count("*").alias("kept"))
    return g.withColumn("dropped", F.when(F.col("model").isNotNull(), F.col("kept")))


def device_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _videos(spark, sf_dir).where("device is not null")
    dims = F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))
    good = F.col("ok") & F.col("width").isNotNull() & F.col("height").isNotNull()
    return v.groupBy("dataset", "device").agg(
        F.min("brand").alias("brand"), F.bool_or("stabilized").alias("stabilized"), F.count("*").alias("n"), F.count_if(F.col("version") == "native").alias("n_native"),
        F.count_distinct("content_id").alias("n_contents"), F.array_join(F.array_sort(F.collect_set("codec")), "/").alias("codecs"), F.array_join(F.array_sort(F.collect_set(F.when(good, dims))), "/").alias("sizes"),
        F.round(F.sum("duration_s") / 60, 3).alias("minutes"), F.round(F.median(F.when(~F.isnan("fps"), F.col("fps"))), 3).alias("fps"),
    )


def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos by dataset and split with margins; -all- marks a margin."""
    v = _videos(spark, sf_dir).select(F.coalesce("dataset", F.lit("-none-")).alias("dataset"), F.coalesce(F.lower("split"), F.lit("-none-")).alias("split"))
    c = v.cube("dataset", "split").agg(F.count("*").alias("n"))
    return c.select(F.coalesce("dataset", F.lit("-all-")).alias("dataset"), F.coalesce("split", F.lit("-all-")).alias("split"), "n")


def most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _videos(spark, sf_dir).where("codec is not null").groupBy("dataset", "codec").agg(F.count("*").alias("n"))
    return c.groupBy("dataset").agg(F.min_by(F.struct("codec", "n"), F.struct(-F.col("n"), F.col("codec"))).alias("x")).select("dataset", "x.*")


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each part under every fold: test = f, val = the next one, train = the rest of those with a fold."""
    v = _videos(spark, sf_dir).where("fold is not null").groupBy("fold").agg(F.count("*").alias("m"))
    k = v.agg((F.max("fold") + 1).alias("k"))
    part = F.when(F.col("fold") == F.col("f"), "test").when(F.col("fold") == (F.col("f") + 1) % F.col("k"), "val").otherwise("train")
    return v.join(F.broadcast(k)).withColumn("f", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).groupBy("f", part.alias("part")).agg(F.sum("m").alias("n"))


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices and contents that stand under more than one fold. Not empty: videos holds rows whose fold contradicts their related ones."""
    v = _videos(spark, sf_dir).where("fold is not null")
    parts = [v.select(F.lit(k).alias("kind"), (same_name(F.col(k)) if k == "device" else F.col(k)).alias("name"), "fold").where("name is not null") for k in ("device", "content_id")]
    return parts[0].union(parts[1]).groupBy("kind", "name").agg(F.count_distinct("fold").alias("folds")).where("folds > 1")


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "model_splits").withColumn("stratum", F.concat_ws("|", "datasets", F.when(F.col("stabilized"), "stab").otherwise("nostab")))
    return R.greedy_deal(g.select("stratum", "model_group", "weight"), "stratum", "model_group", "weight", {"train": 0.7, "val": 0.15, "test": 0.15}, 1)


ATTACKS = ["VISION-attack", "ACID-attack"]


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).where("label is not null")
    return s.select("sample_id", "source", "split", class_code(F.col("label")).alias("y"), W.condition(F.col("source"), F.col("variant"), F.col("social"), ATTACKS, 23).alias("cond"))


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.class_balanced(_weighted(spark, sf_dir), "y").groupBy("y").agg(F.count("*").alias("n"), F.round(F.max("weight"), 6).alias("weight"))


def dataset_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.dataset_balanced(_weighted(spark, sf_dir), "y", "source").groupBy("y", "source").agg(F.count("*").alias("n"), F.round(F.max("weight"), 6).alias("weight"))


def matched_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.matched(_weighted(spark, sf_dir), "y", "cond").groupBy("y", "cond").agg(F.count("*").alias("n"), F.round(F.max("raw"), 6).alias("raw"), F.round(F.max("weight"), 6).alias("weight"))


def attack_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.attack_share(W.matched(_weighted(spark, sf_dir), "y", "cond"), "y", "cond", "weight").select("cond", *r6("share"))


def oversampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.repeated(W.matched(_weighted(spark, sf_dir), "y", "cond").withColumn("raw", F.round("raw", 6)), "raw").groupBy("y").agg(F.count("*").alias("n"))


_CUT = "regexp_extract(split_part(variant, '+', 1), 'crf(\\d+)', 1)"
_WEIGHTED = f"""{SAMPLES}, q AS (SELECT sample_id, source, split, CASE label WHEN 'organic' THEN 0 WHEN 'manipulated' THEN 1 WHEN 'synthetic' THEN 2 END AS y, CASE WHEN source IN ('VISION-attack', 'ACID-attack') THEN split_part(source, '-', 1) || '|crf' || CASE WHEN {_CUT} = '' THEN '23' ELSE {_CUT} END || '|' || social END AS cond FROM u WHERE label IS NOT NULL)"""
_MATCHED = f"""{_WEIGHTED}, c AS (SELECT cond, count(*) FILTER (y = 0) AS g, count(*) FILTER (y = 1) AS a FROM q WHERE cond IS NOT NULL GROUP BY ALL), r AS (SELECT q.*, CASE WHEN y = 0 AND g > 0 AND a > 0 THEN a::DOUBLE / g ELSE 1.0 END AS raw FROM q LEFT JOIN c USING (cond)),
 m AS (SELECT *, raw / ((SELECT count(DISTINCT y) FROM r) * sum(raw) OVER (PARTITION BY y)) * (SELECT count(*) FROM r) AS weight FROM r)"""
SAME = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g')"

QUERIES = {
    "sample_union_schema_pin": samples, "role_by_rank": roles, "half_by_rank": halves, "head_per_group": heads, "seeded_sample": sampled,
    "dedup_keep_last": latest_probe, "dedup_keep_first": first_probe, "merge_runs": merged, "replace_partition": replaced, "probe_reuse": reusable,
    "native_derived_selfjoin": derived, "lookup_join": looked_up, "semi_join_unchanged": unchanged, "anti_join_todo": to_do, "null_safe_merge": null_safe, "null_group_modes": null_groups,
    "device_table": device_table, "crosstab_margins": crosstab, "most_frequent": most_frequent, "folds_masks": folds, "leakage_checks": leaks, "greedy_deal": dealt,
    "class_weights": class_weights, "dataset_weights": dataset_weights, "matched_weights": matched_weights, "attack_share": attack_shares, "weight_oversample": oversampled,
}

SQL = {
    "sample_union_schema_pin": f"WITH {SAMPLES} SELECT * FROM u",
    "role_by_rank": """WITH v AS (SELECT *, dense_rank() OVER (PARTITION BY device ORDER BY content_id)::INT AS rank FROM videos WHERE device IS NOT NULL AND content_id IS NOT NULL)
 SELECT row_id, rank, CASE WHEN NOT coalesce(ok, false) OR coalesce(errata, false) THEN 'excluded' WHEN dataset = 'ACID' THEN CASE WHEN rank <= 5 THEN 'reference' WHEN rank <= 20 THEN 'sample' ELSE 'unused' END WHEN scene_group = 'flat' THEN CASE WHEN version = 'native' THEN 'reference' ELSE 'reference_derived' END ELSE 'sample' END AS new_role FROM v""",
    "half_by_rank": "SELECT row_id, ((row_number() OVER (PARTITION BY device ORDER BY content_id, version, row_id) - 1) % 2)::INT AS half FROM videos WHERE device IS NOT NULL",
    "head_per_group": "SELECT device, row_id, (row_number() OVER (PARTITION BY device ORDER BY content_id, version, row_id) - 1)::INT AS n FROM videos WHERE device IS NOT NULL QUALIFY n < 3",
    "seeded_sample": "SELECT dataset, row_id FROM videos QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY md5('7|' || row_id), row_id) <= 20",
    "dedup_keep_last": "SELECT content_id, version, row_id, load_id FROM inventory QUALIFY row_number() OVER (PARTITION BY content_id, version ORDER BY row_id DESC) = 1",
    "dedup_keep_first": "SELECT content_id, version, row_id, load_id FROM inventory QUALIFY row_number() OVER (PARTITION BY content_id, version ORDER BY row_id) = 1",
    "merge_runs": "SELECT content_id, version, row_id, load_id FROM inventory WHERE load_id IN (1, 2) QUALIFY row_number() OVER (PARTITION BY content_id, version ORDER BY load_id DESC, row_id DESC) = 1",
    "replace_partition": "SELECT dataset, row_id, load_id FROM inventory WHERE load_id = 1 AND (dataset <> 'ACID' OR NOT EXISTS (SELECT 1 FROM inventory WHERE load_id = 2 AND dataset = 'ACID')) UNION ALL SELECT dataset, row_id, load_id FROM inventory WHERE load_id = 2 AND dataset = 'ACID'",
    "probe_reuse": "SELECT DISTINCT a.row_id FROM inventory a JOIN inventory b ON a.path = b.path AND abs(a.size_mb - b.size_mb) < 0.01 WHERE a.load_id = 2 AND b.load_id = 1 AND b.ok",
    "native_derived_selfjoin": "SELECT content_id, n.row_id AS native_row, o.version, o.row_id FROM (SELECT content_id, min(row_id) AS row_id FROM videos WHERE version = 'native' GROUP BY ALL) n LEFT JOIN (SELECT * FROM videos WHERE version <> 'native') o USING (content_id)",
    "lookup_join": f"WITH r AS (SELECT {SAME.format('device')} AS k, arg_min(brand, entry_id) AS registered_brand FROM camera_registry GROUP BY ALL) SELECT row_id, registered_brand FROM videos LEFT JOIN r ON {SAME.format('device')} = k",
    "semi_join_unchanged": "SELECT row_id FROM frames_index f WHERE EXISTS (SELECT 1 FROM videos v WHERE v.content_id = f.content_id AND v.version = f.version AND v.device = f.device)",
    "anti_join_todo": "SELECT row_id FROM videos v WHERE ok AND NOT EXISTS (SELECT 1 FROM frames_index f WHERE f.status = 'ok' AND v.content_id = f.content_id AND v.version = f.version)",
    "null_safe_merge": f"WITH a AS (SELECT fold, count(*) AS attacks FROM (SELECT DISTINCT {_SAME_A} FROM attacks) GROUP BY ALL), s AS (SELECT fold, count(*) AS synthetic FROM (SELECT DISTINCT {_SAME_S} FROM synthetic) GROUP BY ALL) SELECT coalesce(a.fold, s.fold) AS fold, attacks, synthetic FROM a FULL JOIN s ON coalesce(a.fold, -1) = coalesce(s.fold, -1)",
    "null_group_modes": "SELECT model, kept, CASE WHEN model IS NOT NULL THEN kept END AS dropped FROM (SELECT model, count(*) AS kept FROM predictions GROUP BY ALL)",
    "device_table": """SELECT dataset, device, min(brand) AS brand, bool_or(stabilized) AS stabilized, count(*) AS n, count(*) FILTER (version = 'native') AS n_native, count(DISTINCT content_id) AS n_contents, coalesce(array_to_string(list_sort(list_distinct(list(codec))), '/'), '') AS codecs,
 coalesce(array_to_string(list_sort(list_distinct(list(width || 'x' || height) FILTER (ok AND width IS NOT NULL AND height IS NOT NULL))), '/'), '') AS sizes, round(sum(duration_s) / 60, 3) AS minutes, round(median(fps) FILTER (NOT isnan(fps)), 3) AS fps FROM videos WHERE device IS NOT NULL GROUP BY ALL""",
    "crosstab_margins": "SELECT coalesce(dataset, '-all-') AS dataset, coalesce(split, '-all-') AS split, count(*) AS n FROM (SELECT coalesce(dataset, '-none-') AS dataset, coalesce(lower(split), '-none-') AS split FROM videos) GROUP BY CUBE (dataset, split)",
    "most_frequent": "SELECT * FROM (SELECT dataset, codec, count(*) AS n FROM videos WHERE codec IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY n DESC, codec) = 1",
    "folds_masks": "WITH k AS (SELECT max(fold) + 1 AS k FROM videos), f AS (SELECT unnest(range(k))::INT AS f, k FROM k) SELECT f, CASE WHEN fold = f THEN 'test' WHEN fold = (f + 1) % k THEN 'val' ELSE 'train' END AS part, count(*) AS n FROM videos, f WHERE fold IS NOT NULL GROUP BY ALL",
    "leakage_checks": f"SELECT kind, name, count(DISTINCT fold) AS folds FROM (SELECT 'device' AS kind, {SAME.format('device')} AS name, fold FROM videos UNION ALL SELECT 'content_id', content_id, fold FROM videos) WHERE fold IS NOT NULL AND name IS NOT NULL GROUP BY ALL HAVING folds > 1",
    "class_weights": f"WITH {_WEIGHTED} SELECT y, count(*) AS n, round((SELECT count(*) FROM q)::DOUBLE / ((SELECT count(*) FROM (SELECT DISTINCT y FROM q)) * count(*)), 6) AS weight FROM q GROUP BY ALL",
    "dataset_weights": f"WITH {_WEIGHTED}, c AS (SELECT y, source, count(*) AS n FROM q GROUP BY ALL) SELECT y, source, n, round((SELECT count(*) FROM q)::DOUBLE / ((SELECT count(DISTINCT y) FROM q) * count(*) OVER (PARTITION BY y) * n), 6) AS weight FROM c",
    "matched_weights": f"WITH {_MATCHED} SELECT y, cond, count(*) AS n, round(max(raw), 6) AS raw, round(max(weight), 6) AS weight FROM m GROUP BY ALL",
    "attack_share": f"WITH {_MATCHED} SELECT cond, round(sum(CASE WHEN y = 1 THEN weight ELSE 0 END) / sum(weight), 6) AS share FROM m WHERE cond IS NOT NULL GROUP BY cond HAVING count(*) FILTER (y = 1) > 0",
    "weight_oversample": f"WITH {_MATCHED} SELECT y, sum(greatest(1, round_even(round(raw, 6), 0)))::BIGINT AS n FROM m GROUP BY ALL",
}
