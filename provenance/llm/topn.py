"""The N best items of every group (problem 3): secondary sort, then a stream that emits N rows a group."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_n(batches: Iterator, n: int) -> Iterator:
    """Of Arrow batches (group, item, score …) sorted by group, then best first: the first n different items of each group.

    Holds one batch and at most n items of the group that is open across its border, never a group.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    open_group, seen = None, set()
    for batch in batches:
        if not batch.num_rows:
            continue
        groups, items = (pc.dictionary_encode(batch.column(i)) for i in (0, 1))
        g, it, names = groups.indices.to_numpy(), items.indices.to_numpy(), items.dictionary
        starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])).tolist()
        ends = [*starts[1:], len(g)]
        keep = []
        for start, end in zip(starts, ends):
            if start or (first := groups.dictionary[int(g[0])].as_py()) != open_group:
                seen = set()
                if not start:
                    open_group = first
            for i in range(start, end):
                if len(seen) >= n:
                    break
                # a few names at most are read for each group
                if (x := names[int(it[i])].as_py()) not in seen:
                    seen.add(x)
                    keep.append(i)
        open_group = groups.dictionary[int(g[-1])].as_py()
        if keep:
            yield batch.take(pa.array(keep))


def top_n(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """(group, item, score, rank) of the n items with the highest score in each group; fewer if it has fewer.

    An item counts once per group, with its highest score. Equal scores: the item first in byte order goes first. Rows with
    a null group, item or score, or a NaN score, are left out; -0.0 is 0.0.

    Each task first cuts its own rows to n a group by the same sort and stream, so of a group that holds a third of all
    rows no more than n rows a task are shuffled. An item's best row survives its task's cut, as fewer than n items beat it.
    """
    s = F.col(score).cast("double")
    rows = df.where(F.col(group).isNotNull() & F.col(item).isNotNull() & s.isNotNull() & ~F.isnan(s)).select(F.col(group).alias("g"), F.col(item).alias("i"), (s + F.lit(0.0)).alias("s"))
    order = [F.asc("g"), F.desc("s"), F.asc("i")]

    def cut(x: DataFrame) -> DataFrame:
        return x.sortWithinPartitions(*order).mapInArrow(lambda b: first_n(b, n), x.schema)

    best = cut(cut(rows).repartition("g"))
    ranked = best.mapInArrow(_numbered, "g string, i string, s double, r int")
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), F.col("r").alias("rank"))


def _numbered(batches: Iterator) -> Iterator:
    """first_n's rows with their place in the group."""
    import pyarrow as pa

    group, at = None, 0
    for batch in batches:
        places = []
        for x in batch.column(0).to_pylist():
            group, at = x, at + 1 if x == group else 1
            places.append(at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int32())], ["g", "i", "s", "r"])
