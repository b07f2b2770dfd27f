"""Queries of parsing, keys, paths, JSON and freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import plain_path, same_name
from ..sources import parsers as S
from ..sources.tables import table


def parse_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.file_names(table(spark, sf_dir, "inventory").select("row_id", "path"), "path").drop("path")


def parse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.file_names(table(spark, sf_dir, "inventory").select("row_id", "path"), "path").where("not parsed").select("row_id", "path")


def notebook_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ipynb texts read as JSON: cells by type; a text that is no JSON has none and an error."""
    docs = table(spark, sf_dir, "documents").where("layout = 'ipynb' and text is not null and trim(text) <> ''").select("doc_id", "text")
    j = F.from_json("text", "cells array<struct<cell_type:string>>, nbformat int")
    cells = F.col("j.cells")
    return docs.withColumn("j", j).select("doc_id", F.coalesce(F.size(cells), F.lit(0)).alias("cells"), F.coalesce(F.size(F.filter(cells, lambda c: c["cell_type"] == "code")), F.lit(0)).alias("code"), cells.isNotNull().alias("ok"))


def key_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera model keys: brand and model in lower case without other signs."""
    k = F.regexp_replace(F.lower(F.concat_ws("", "brand", "model")), "[^a-z0-9]", "")
    return table(spark, sf_dir, "videos").select("row_id", k.alias("norm_key"), same_name(F.col("model_group")).alias("group_key"))


def path_relocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.relocated(table(spark, sf_dir, "frames_index").select("row_id", "frames_path"), ["frames_path"], "data/frames", "/mnt/store/frames")


def path_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plain_path(F.col("path"))
    return table(spark, sf_dir, "frame_files").select("file_id", F.element_at(F.split(p, "/"), -1).alias("base"), F.regexp_extract(F.element_at(F.split(p, "/"), -1), r"^(.*?)(\.[^.]*)?$", 1).alias("stem"), F.size(F.split(p, "/")).alias("depth"))


def signature_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads whose probes, by path, size and codec, are not those of the load they are compared with."""
    inv = table(spark, sf_dir, "inventory").where("load_id is not null")
    now = S.signature(inv, ["load_id"], ["path", "size_mb", "codec"])
    bases = table(spark, sf_dir, "loads").where("base_load_id is not null").select("load_id", "base_load_id")
    before = bases.join(now.select(F.col("load_id").alias("base_load_id"), "stamp"), "base_load_id").select("load_id", "stamp")
    return S.stale(now.join(bases.select("load_id"), "load_id"), before, ["load_id"])


def frame_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platform copies: scaled even sizes and the bit rate, by half-even rounding."""
    v = table(spark, sf_dir, "videos").where("width > 0 and height > 0 and fps > 0 and not isnan(fps)")
    scale = F.least(F.lit(1.0), F.lit(848.0) / F.greatest("width", "height"))
    w, h = (2 * F.bround(F.col(c) * scale / 2).cast("int") for c in ("width", "height"))
    return v.select("row_id", w.alias("w"), h.alias("h"), F.bround(w * h * F.col("fps") * 0.1 / 1000 + 1e-9, 0).cast("bigint").alias("kbps"))


QUERIES = {
    "parse_ids": parse_ids, "parse_rejects": parse_rejects, "json_probe": notebook_json, "key_normalise": key_normalise, "path_relocate": path_relocate, "path_parts": path_resolve,
    "signature_freshness": signature_freshness, "rate_model": frame_rates,
}

_V, _A, _FV = r"(D\d+)_(?:flat|indoor|outdoor|natural)_(?:still|move|pan|panrot)_(\d+)_([a-z]+)\.(\w+)$", r"/(M\d+_D[A-Z])/ACID_(?:train|eval)_M\d+_D[A-Z]_T(\d+)_([a-z]+)\.(\w+)$", r"/(FV_D\d+)/FV_D\d+_\w+-\w+_V(\d+)_([a-z]+)\.(\w+)$"
_PART = "CASE " + " ".join(f"WHEN regexp_matches(path, '{p}') THEN regexp_extract(path, '{p}', {{k}})" for p in (_V, _A, _FV)) + " END"
_COLL = f"CASE WHEN regexp_matches(path, '{_V}') THEN 'VISION' WHEN regexp_matches(path, '{_A}') THEN 'ACID' WHEN regexp_matches(path, '{_FV}') THEN 'FloreView' END"
SQL = {
    "parse_ids": f"SELECT row_id, {_COLL} AS collection, coalesce({_COLL} IS NOT NULL, false) AS parsed, " + ", ".join(f"{_PART.format(k=k)} AS {n}" for k, n in enumerate(("device", "number", "version", "ending"), 1)) + " FROM inventory",
    "parse_rejects": f"SELECT row_id, path FROM inventory WHERE {_COLL} IS NULL",
    "json_probe": """WITH d AS (SELECT doc_id, CASE WHEN json_valid(text) AND json_type(text, '$.cells') = 'ARRAY' THEN text END AS t FROM documents WHERE layout = 'ipynb' AND text IS NOT NULL AND trim(text) <> '')
 SELECT doc_id, coalesce(json_array_length(t, '$.cells'), 0)::INT AS cells, coalesce(len(list_filter(json_extract_string(t, '$.cells[*].cell_type'), lambda x: x = 'code')), 0)::INT AS code, t IS NOT NULL AS ok FROM d""",
    "key_normalise": "SELECT row_id, regexp_replace(lower(concat(brand, model)), '[^a-z0-9]', '', 'g') AS norm_key, regexp_replace(lower(model_group), '[^\\p{L}\\p{M}\\p{N}]', '', 'g') AS group_key FROM videos",
    "path_relocate": "SELECT row_id, CASE WHEN frames_path = 'data/frames' OR starts_with(frames_path, 'data/frames/') THEN '/mnt/store/frames' || substr(frames_path, 12) ELSE frames_path END AS frames_path FROM frames_index",
    "path_parts": "WITH p AS (SELECT file_id, path, split_part(path, '/', -1) AS base FROM frame_files) SELECT file_id, base, regexp_extract(base, '^(.*?)(\\.[^.]*)?$', 1) AS stem, len(string_split(path, '/'))::INT AS depth FROM p",
    "signature_freshness": """WITH s AS (SELECT load_id, list(row(path, size_mb, codec) ORDER BY path, size_mb, codec) AS c FROM inventory WHERE load_id IS NOT NULL GROUP BY ALL)
 SELECT a.load_id FROM s a JOIN loads l ON l.load_id = a.load_id AND l.base_load_id IS NOT NULL LEFT JOIN s b ON b.load_id = l.base_load_id WHERE a.c IS DISTINCT FROM b.c""",
    "rate_model": """WITH v AS (SELECT *, least(1.0::DOUBLE, 848.0::DOUBLE / greatest(width, height)) AS k FROM videos WHERE width > 0 AND height > 0 AND fps > 0 AND NOT isnan(fps)), s AS (SELECT row_id, fps, 2 * round_even(width * k / 2, 0)::INT AS w, 2 * round_even(height * k / 2, 0)::INT AS h FROM v)
 SELECT row_id, w, h, round_even(w * h * fps * 0.1::DOUBLE / 1000 + 1e-9, 0)::BIGINT AS kbps FROM s""",
}
