"""The queries of problems 1, 2, 3, 6, 7 and 8, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import same_name
from ..sources.tables import cut_lineage, table
from . import components, cutoff, packing, privacy, tokens, topn

SHARES = {"train": 0.6, "val": 0.2, "test": 0.2}


def _cut(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "keep_targets")
    wanted = table(spark, sf_dir, "predictions").join(targets.where("keep_permille is not null").select("model"), "model", "left_semi")
    scored = cutoff.scored_once(wanted, "model", ["split_name", "sample_id"], "p_organic", 0.0, 1.0)
    return cutoff.keep_fraction(scored, "model", "p_organic", targets, "keep_permille")


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_found: the records at or above their model's cutoff."""
    return _cut(spark, sf_dir)[0].select("model", "split_name", "sample_id")


def cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_report: cutoff and kept size of every model with a target, and the bracket that its cutoff was found in."""
    return _cut(spark, sf_dir)[1]


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fold, names) per row of model_splits, the same names made equal, in order, empty ones out.

    A name may hold a space, so white space divides only a list without another separator.
    """
    devices = F.col("devices")
    parts = F.when(devices.rlike(r"[,;|/]"), F.split(devices, r"[,;|/]")).otherwise(F.split(devices, r"\s+"))
    names = F.transform(F.concat(F.array("model_group"), F.coalesce(parts, F.array().cast("array<string>"))), lambda x: same_name(F.coalesce(x, F.lit(""))))
    return table(spark, sf_dir, "model_splits").select("fold", F.array_distinct(F.filter(names, lambda x: x != "")).alias("names")).where(F.size("names") > 0)


def _pairs(listings: DataFrame) -> DataFrame:
    return listings.select(F.get("names", F.lit(0)).alias("a"), F.explode("names").alias("b"))


def fold_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_found: the videos whose fold is not that of their related set. A set whose rows have different folds has none."""
    listings = _listings(spark, sf_dir)
    sets = components.hash_to_min(_pairs(listings), "a", "b")
    folds = listings.where("fold is not null").select("fold", F.get("names", F.lit(0)).alias("node")).join(sets, "node").groupBy("component").agg(F.min("fold").alias("f"), F.max("fold").alias("g"))
    fold_of = sets.join(folds.where("f = g"), "component").select("node", F.col("f").alias("set_fold"))
    videos = table(spark, sf_dir, "videos").where("fold is not null").select("row_id", "fold", same_name(F.coalesce("device", "model_group")).alias("node"))
    return videos.join(fold_of, "node").where("fold <> set_fold").select("row_id")


def _dealt(spark: SparkSession, sf_dir: str, shares: dict[str, float], seeds: int) -> DataFrame:
    """(row_id, component, split) of every video. A video of no name is a set of its own."""
    name = {c: F.nullif(same_name(F.col(c)), F.lit("")) for c in ("device", "model_group")}
    videos = table(spark, sf_dir, "videos").select("row_id", name["device"].alias("d"), name["model_group"].alias("g"))
    tied = videos.where("d is not null or g is not null").select(F.coalesce("d", "g").alias("a"), F.coalesce("g", "d").alias("b")).distinct()
    sets = components.hash_to_min(_pairs(_listings(spark, sf_dir)).union(tied), "a", "b")
    own = F.concat(F.lit("row "), F.col("row_id").cast("string"))
    placed = videos.withColumn("node", F.coalesce("d", "g")).join(sets, "node", "left").select("row_id", F.coalesce("component", own).alias("component"))
    sizes = cut_lineage(placed.groupBy("component").agg(F.count("*").alias("n")))
    seed = components.best_seed(sizes, "component", "n", shares, seeds)
    return placed.withColumn("split", components.rendezvous(F.col("component"), shares, seed))


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_splits: a split for every video, related videos in one."""
    return _dealt(spark, sf_dir, SHARES, 64)


def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_shares: records, sets, largest set and share of each split, beside the share wanted."""
    per_set = splits(spark, sf_dir).groupBy("split", "component").agg(F.count("*").alias("n"))
    sums = per_set.groupBy("split").agg(F.sum("n").alias("records"), F.count("*").alias("sets"), F.max("n").alias("largest_set"))
    total = per_set.agg(F.sum("n").alias("total"))
    wanted = F.create_map(*(F.lit(x) for k, v in SHARES.items() for x in (k, v)))
    return sums.join(F.broadcast(total)).select("split", "records", "sets", "largest_set", (F.col("records") / F.col("total")).alias("share"), wanted[F.col("split")].alias("wanted"))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_n(table(spark, sf_dir, "scores").select("query", "candidate", "pce0"), "query", "candidate", "pce0", 3)


def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_found: each query's three best candidates."""
    return _best(spark, sf_dir).select("query", "candidate")


def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_ranked: the same with score and rank."""
    return _best(spark, sf_dir)


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_ids: each document's token ids."""
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_restored: each document's text out of its token ids."""
    return tokens.decode(token_ids(spark, sf_dir), "doc_id", "ids")


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = tokens.count(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens", packing.CAPACITY)


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p7_containers: tier, container, place and step of every notebook, or piece of one longer than a container."""
    return _packed(spark, sf_dir)[0]


def container_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p7_steps: containers, tokens, unused space and cost of each step."""
    return packing.step_report(_packed(spark, sf_dir)[0], packing.CAPACITY)


def personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_found: each piece of personal information, once per document, kind and wording."""
    return privacy.find(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "name_list"))


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_masked: each text with typed placeholders in place of personal information, all else unchanged."""
    return privacy.mask(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "name_list"))


QUERIES = {
    "p1_found": kept, "p1_report": cutoffs,
    "p2_found": fold_breaks, "p2_shares": split_sizes, "p2_splits": splits,
    "p3_found": best_candidates, "p3_ranked": ranked_candidates,
    "p6_ids": token_ids, "p6_restored": decoded,
    "p7_containers": containers, "p7_steps": container_steps,
    "p8_found": personal, "p8_masked": masked,
}

_SCORED = "s AS (SELECT model, split_name, sample_id, max(p_organic) AS p FROM predictions WHERE model IN (SELECT model FROM keep_targets) AND p_organic BETWEEN 0 AND 1 GROUP BY ALL)"
_CUTS = f"{_SCORED}, r AS (SELECT s.model, p, row_number() OVER (PARTITION BY s.model ORDER BY p DESC) AS k, count(*) OVER (PARTITION BY s.model) AS n, keep_permille FROM s JOIN keep_targets USING (model)), c AS (SELECT model, max(p) AS cutoff FROM r WHERE k * 1000 >= keep_permille::BIGINT * n GROUP BY ALL)"
_NAME = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g')"
_LISTED = f"""m AS (SELECT row_number() OVER () AS i, fold, list_filter([{_NAME.format("coalesce(x, '')")} FOR x IN [model_group] || CASE WHEN regexp_matches(devices, '[,;|/]') THEN regexp_split_to_array(devices, '[,;|/]') ELSE regexp_split_to_array(coalesce(devices, ''), '\\s+') END], lambda n: n <> '') AS names FROM model_splits),
 e AS (SELECT DISTINCT 'row ' || i AS a, n AS b FROM (SELECT i, unnest(names) AS n FROM m)), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"""
SQL = {
    "p1_found": f"WITH {_CUTS} SELECT model, split_name, sample_id FROM s JOIN c USING (model) WHERE p >= cutoff",
    "p2_found": f"""WITH RECURSIVE {_LISTED}, w AS (SELECT DISTINCT a AS node, a AS seen FROM g UNION SELECT w.node, g.b FROM w JOIN g ON w.seen = g.a), k AS (SELECT node, min(seen) AS component FROM w GROUP BY ALL),
 f AS (SELECT component, min(fold) AS fold FROM k JOIN m ON node = 'row ' || i WHERE fold IS NOT NULL GROUP BY component HAVING min(fold) = max(fold))
 SELECT row_id FROM videos v JOIN k ON node = {_NAME.format("coalesce(device, model_group)")} JOIN f USING (component) WHERE v.fold <> f.fold""",
    "p3_found": "SELECT query, candidate FROM (SELECT query, candidate, max(pce0) AS s FROM scores WHERE pce0 IS NOT NULL AND NOT isnan(pce0) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, candidate) <= 3",
    "p3_ranked": "SELECT query, candidate, s AS pce0, row_number() OVER (PARTITION BY query ORDER BY s DESC, candidate)::INT AS rank FROM (SELECT query, candidate, max(pce0) AS s FROM scores WHERE pce0 IS NOT NULL AND NOT isnan(pce0) GROUP BY ALL) QUALIFY rank <= 3",
    "p6_restored": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
