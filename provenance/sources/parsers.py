"""Sources: file names, probe output, archives, arrays, relocation and freshness."""

from __future__ import annotations

import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# fixed values: the forms of file names of the three collections
VISION_NAME = r"(?<device>D\d+)_(?<scene>flat|indoor|outdoor|natural)_(?<motion>still|move|pan|panrot)_(?<number>\d+)_(?<version>[a-z]+)\.(?<ending>\w+)$"
ACID_NAME = r"/(?<device>M\d+_D[A-Z])/ACID_(?<split>train|eval)_M\d+_D[A-Z]_T(?<number>\d+)_(?<version>[a-z]+)\.(?<ending>\w+)$"
FLOREVIEW_NAME = r"/(?<device>FV_D\d+)/FV_D\d+_(?<kind>\w+)-(?<codec>\w+)_V(?<number>\d+)_(?<version>[a-z]+)\.(?<ending>\w+)$"


def named_parts(c: Column, pattern: str) -> Column:
    """A struct of the named parts of a pattern, null where it does not match."""
    import re

    names = re.findall(r"\?<(\w+)>", pattern)
    plain = re.sub(r"\?<\w+>", "", pattern)
    return F.when(c.rlike(plain), F.struct(*(F.regexp_extract(c, plain, k + 1).alias(n) for k, n in enumerate(names))))


def file_names(df: DataFrame, path: str) -> DataFrame:
    """df with collection, device, number, version and ending out of the path; parsed is false, and these null, where no form fits, so that rejects stay."""
    tries = [("VISION", VISION_NAME), ("ACID", ACID_NAME), ("FloreView", FLOREVIEW_NAME)]
    common = ("device", "number", "version", "ending")
    picked = F.coalesce(*(F.when(named_parts(F.col(path), p).isNotNull(), F.struct(F.lit(n).alias("collection"), *(named_parts(F.col(path), p)[k].alias(k) for k in common))) for n, p in tries))
    return df.withColumn("__x", picked).select(*df.columns, F.col("__x").isNotNull().alias("parsed"), "__x.collection", *(f"__x.{k}" for k in common))


PROBE = "streams array<struct<codec_type:string,codec_name:string,profile:string,width:int,height:int,r_frame_rate:string,pix_fmt:string,nb_frames:string,side_data_list:array<struct<rotation:double>>,tags:struct<rotate:string>>>, format struct<format_name:string,duration:string,size:string,bit_rate:string>"


def rational(c: Column) -> Column:
    """"30000/1001" as a number; null for a zero denominator or no number."""
    top, bottom = F.try_element_at(F.split(c, "/"), F.lit(1)).try_cast("double"), F.coalesce(F.try_element_at(F.split(c, "/"), F.lit(2)), F.lit("1")).try_cast("double")
    return F.when(bottom != 0, top / bottom)


def probed(df: DataFrame, text: str) -> DataFrame:
    """df with the fields of a prober's JSON: one row a file, ok and error instead of failures."""
    j = F.from_json(text, PROBE, {"mode": "PERMISSIVE"})
    video = F.get(F.filter(F.col("__j.streams"), lambda s: s["codec_type"] == "video"), F.lit(0))
    v, f = F.col("__v"), F.col("__j.format")
    turned = F.coalesce(F.get(v["side_data_list"], F.lit(0))["rotation"], v["tags"]["rotate"].try_cast("double"), F.lit(0.0))
    error = F.when(F.col(text).isNull(), "no output").when(F.col("__j").isNull() | (F.col("__j.streams").isNull() & f.isNull()), "not JSON").when(v.isNull(), "no video stream")
    return df.withColumn("__j", j).withColumn("__v", video).select(
        *df.columns, v["codec_name"].alias("codec"), v["profile"].alias("profile"), v["width"].alias("width"), v["height"].alias("height"), rational(v["r_frame_rate"]).alias("fps"), v["nb_frames"].try_cast("int").alias("n_frames"),
        F.pmod(F.round(turned).cast("int"), F.lit(360)).alias("rotation"), f["duration"].try_cast("double").alias("duration_s"), (f["bit_rate"].try_cast("double") / 1000).alias("bitrate_kbps"), error.isNull().alias("ok"), error.alias("error"),
    )


def relocated(df: DataFrame, columns: list[str], old: str, new: str) -> DataFrame:
    """df with the path prefix old put as new, where a path starts with it as a whole; nulls stay."""
    old = old.rstrip("/")

    def moved(c: str) -> Column:
        return F.when((F.col(c) == old) | F.col(c).startswith(old + "/"), F.concat(F.lit(new.rstrip("/")), F.substring(F.col(c), len(old) + 1, 1_000_000))).otherwise(F.col(c)).alias(c)

    return df.withColumns({c: moved(c) for c in columns})


def signature(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, n, stamp): a stamp of a group's rows that does not hang on their order, by sums of hashes with partial aggregation."""
    a, b = F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)
    total = F.sum(a.cast("decimal(38,0)")), F.sum(b.cast("decimal(38,0)"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sha1(F.concat_ws("|", F.count("*").cast("string"), *(t.cast("string") for t in total))).alias("stamp"))


def stale(now: DataFrame, before: DataFrame, by: list[str]) -> DataFrame:
    """The groups of now whose stamp is not that of before."""
    return now.join(before, [*by, "stamp"], "left_anti").select(*by)


def npy_frames(df: DataFrame, content: str, limit: int | None = None) -> DataFrame:
    """Binary .npy contents of shape (n, h, w), a row a frame: (all other columns, frame, h, w, y). A content that is no such array gives no row."""
    keep_ = [f for f in df.schema if f.name != content]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep_), "frame int, h int, w int, y binary"])

    def read(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for row in pdf.to_dict("records"):
                try:
                    a = np.load(io.BytesIO(row.pop(content)), allow_pickle=False)
                except (ValueError, EOFError, TypeError):
                    continue
                if a.ndim == 3:
                    yield pd.DataFrame([{**row, "frame": k, "h": a.shape[1], "w": a.shape[2], "y": a[k].tobytes()} for k in range(len(a) if limit is None else min(limit, len(a)))])

    return df.mapInPandas(read, schema)


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TarSource(DataSource):
    """spark.read.format("tar_quota").option("paths", "a.tar.gz,b.tar.gz").option("quota", 2).load(): the first members, in the
    order of each archive, of every folder, up to the quota. Archives are read as streams, one task each."""

    @classmethod
    def name(cls) -> str:
        return "tar_quota"

    def schema(self) -> str:
        return "archive string, folder string, name string, size bigint, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _TarReader(self.options)


class _TarReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options["paths"].split(",") if p]
        self.quota = int(options.get("quota", 2**31))

    def partitions(self) -> list:
        return [_Archive(p) for p in self.paths]

    def read(self, partition) -> Iterator:
        import tarfile
        from collections import Counter

        taken: Counter = Counter()
        with tarfile.open(partition.path, "r|*") as tar:
            for member in tar:
                folder, _, name = member.name.rpartition("/")
                if member.isfile() and taken[folder] < self.quota:
                    taken[folder] += 1
                    yield partition.path, folder, name, member.size, tar.extractfile(member).read()


def lookup_list(lines: Column, pattern: str) -> Column:
    """All (first group) matches of a pattern in a text, in order, without repeats."""
    return F.array_distinct(F.regexp_extract_all(lines, F.lit(pattern), F.lit(1)))


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with header under a stated schema; values that do not fit are null."""
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a parquet table; Spark's commit makes them seen all or not at all."""
    df.write.mode("append").parquet(path)


def markdown(df: DataFrame, most: int = 10_000) -> str:
    """A small table as Markdown. More rows than `most` are an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|")
    lines = [df.columns, ["---"] * len(df.columns), *rows]
    return "\n".join(f"| {' | '.join(map(cell, r))} |" for r in lines)


_TEX = dict(zip("\\&%$#_{}~^", (r"\textbackslash{}", r"\&", r"\%", r"\$", r"\#", r"\_", r"\{", r"\}", r"\textasciitilde{}", r"\textasciicircum{}")))


def tex(s: str) -> str:
    return "".join(_TEX.get(c, c) for c in s)
