"""Running sums and neighbours over an order, spread over tasks however large a group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, str], nexts: dict[str, str] | None = None) -> DataFrame:
    """df with running sums (new name: column), the row itself included, and the next row's values (new name: column), in each
    group of `by` in the given order, which must be total. A null in a summed column counts as 0.

    Rows are parted by ranges of (by, order) and sorted there; only a total and a first row of each part are looked at across
    parts. So no task holds a group, and one group of all rows is as fast as many.
    """
    nexts = nexts or {}
    parted = df.repartitionByRange(*(F.asc(c) for c in by), *order).withColumn("__part", F.spark_partition_id())
    parted = cut_lineage(parted)
    inner = Window.partitionBy(*by, "__part").orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = parted.withColumns({new: F.sum(F.coalesce(F.col(c), F.lit(0))).over(upto) for new, c in sums.items()} | {f"__next_{new}": F.lead(F.struct(c)).over(inner) for new, c in nexts.items()})
    parts = parted.groupBy(*by, "__part").agg(*(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"__sum_{new}") for new, c in sums.items()), F.count("*").alias("__rows"))
    across = Window.partitionBy(*by).orderBy("__part")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    if nexts:
        first = parted.withColumn("__rn", F.row_number().over(inner)).where("__rn = 1").select(*(F.col(c).alias(f"__p{i}") for i, c in enumerate(by)), F.col("__part").alias("__q"), F.struct(*(F.struct(c).alias(new) for new, c in nexts.items())).alias("__first"))
        on = F.col("__part") == F.col("__q")
        for i, c in enumerate(by):
            on = on & F.col(c).eqNullSafe(F.col(f"__p{i}"))
        parts = parts.join(first, on).drop("__q", *(f"__p{i}" for i in range(len(by)))).withColumn("__after", F.lead("__first").over(across))
    offsets = parts.withColumns({f"__off_{new}": F.coalesce(F.sum(f"__sum_{new}").over(before), F.lit(0)) for new in sums})
    keep = [*(F.col(f"o.__off_{new}") for new in sums), *([F.col("o.__after")] if nexts else [])]
    on = F.col("l.__part") == F.col("o.__part")
    for c in by:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}"))
    # as many rows as parts and groups in them: Catalyst broadcasts this side only below its own threshold
    joined = local.alias("l").join(offsets.alias("o"), on).select("l.*", *keep)
    out = joined.withColumns({new: F.col(new) + F.col(f"__off_{new}") for new in sums})
    for new, c in nexts.items():
        out = out.withColumn(new, F.coalesce(F.col(f"__next_{new}"), F.col("__after")[new])[c])
    return out.drop("__part", "__after", *(f"__off_{n}" for n in sums), *(f"__next_{n}" for n in nexts))
