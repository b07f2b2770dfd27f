"""Filling fixed-capacity containers (problem 7): hierarchical packing over context-size tiers, planned on the histogram of sizes.

A plan knows only how many pieces there are of each size, so it is as small for a corpus of any size; pieces find their
place in it by their rank among those of their size.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

CAPACITY = 4096
#: Containers of a step group.
STEP = 64
#: Pieces of one size that are ranked together in one task.
RANKED = 500_000


def tiers(capacity: int) -> list[int]:
    """Context sizes, longest first: the capacity and its halves down to a sixteenth. A piece goes to the shortest that holds it."""
    return [max(1, capacity >> k) for k in range(5)]


@dataclass
class Plan:
    """rows: (size, lo, hi, first, each, held, start): of the pieces of a size those ranked lo until before hi go, `each` to
    a container, to the containers from `first` on, as place `held` and at token `start` there and after. runs: (first,
    containers, cost, tier, used) of like containers."""

    rows: list[tuple[int, ...]]
    runs: list[tuple[int, ...]]
    containers: int


def plan(sizes: dict[int, int], capacity: int) -> Plan:
    """From the longest tier to the shortest: a tier's pieces, larger ones first, fill the smallest gap of earlier
    containers that takes them, and what finds none opens containers of its tier, as many pieces in each as fit.

    All containers of like fill are worked at once, so the work hangs on the number of sizes, not of pieces.
    """
    # by gap: runs of like containers (first, containers, pieces in each, cost of each, tier)
    gaps: dict[int, list[tuple[int, int, int, int, int]]] = {}
    order: list[int] = []
    rows: list[tuple[int, ...]] = []
    runs: list[tuple[int, ...]] = []
    opened = 0

    def put(gap: int, run: tuple[int, int, int, int, int]) -> None:
        if not run[1]:
            return
        if not gap:
            runs.append((run[0], run[1], run[3], run[4], capacity))
            return
        if gap not in gaps:
            bisect.insort(order, gap)
            gaps[gap] = []
        gaps[gap].append(run)

    levels = tiers(capacity)
    for level, top in enumerate(levels):
        below = levels[level + 1] if level + 1 < len(levels) else 0
        for size in sorted((s for s in sizes if below < s <= top), reverse=True):
            lo, left = 0, sizes[size]
            while left:
                if (at := bisect.bisect_left(order, size)) < len(order):
                    gap = order[at]
                    first, many, held, cost, tier = gaps[gap].pop()
                    if not gaps[gap]:
                        del gaps[gap], order[at]
                else:
                    gap, first, held, cost, tier = capacity, opened, 0, 0, top
                    many = -(-left // (capacity // size))
                    opened += many
                each = gap // size
                full = min(many, left // each)
                for containers, k in ((full, each), (1, left - full * each if full < many else 0)):
                    if containers and k:
                        rows.append((size, lo, lo + containers * k, first, k, held, capacity - gap))
                        put(gap - k * size, (first, containers, held + k, cost + k * size * size, tier))
                        first, many, lo, left = first + containers, many - containers, lo + containers * k, left - containers * k
                put(gap, (first, many, held, cost, tier))
    for gap, rest in gaps.items():
        runs += [(first, many, cost, tier, capacity - gap) for first, many, _, cost, tier in rest]
    return Plan(sorted(rows), sorted(runs), opened)


def _placed(batches: Iterator, planned: Plan, capacity: int, step: int) -> Iterator:
    """(doc, piece, size, rank) to its place, by binary search in the plan."""
    import numpy as np
    import pyarrow as pa

    size, lo, _, first, each, held, start = (np.array(x, np.int64) for x in zip(*planned.rows)) if planned.rows else [np.zeros(0, np.int64)] * 7
    rfirst, rmany, cost, tier, _ = (np.array(x, np.int64) for x in zip(*planned.runs)) if planned.runs else [np.zeros(0, np.int64)] * 5
    by_cost = np.argsort(-cost, kind="stable")
    before = np.empty(len(cost), np.int64)
    before[by_cost] = np.cumsum(rmany[by_cost]) - rmany[by_cost]
    steps = max(1, -(-planned.containers // step))
    wide = np.int64(1) << 44
    levels = np.array(tiers(capacity)[::-1], np.int64)
    for batch in batches:
        piece, n, rank = (batch.column(i).to_numpy() for i in (1, 2, 3))
        row = np.searchsorted(size * wide + lo, n * wide + rank, side="right") - 1
        nth = rank - lo[row]
        container = first[row] + nth // each[row]
        within = nth % each[row]
        run = np.searchsorted(rfirst, container, side="right") - 1
        # containers from the dearest to the cheapest are dealt to the steps to and fro
        turn, at = np.divmod(before[run] + container - rfirst[run], steps)
        out = [batch.column(0), piece, piece * capacity, n, levels[np.searchsorted(levels, n)], tier[run], container, held[row] + within, start[row] + within * n, np.where(turn % 2, steps - 1 - at, at)]
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], OUT)


OUT = ["doc", "piece", "first_token", "n_tokens", "tier", "container_tier", "container", "place", "container_token", "step"]


def pack(sizes: DataFrame, doc: str, n: str, capacity: int = CAPACITY, step: int = STEP) -> tuple[DataFrame, Plan]:
    """A row for every document, or piece of one longer than the capacity, and the plan.

    Columns: doc, piece (from 0), first_token (of the piece in its document), n_tokens, tier, container_tier (that of its
    longest piece), container (numbered from 0 without gaps), place in it, container_token (where it starts there), step.
    Documents of null or no size need no container and have no row. Steps hold `step` containers, one less at the end, whose
    costs (sums of squared piece sizes) differ by no more than twice the dearest container's.
    """
    piece = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(`{n}` - 1) div {capacity}"))).alias("piece")
    pieces = sizes.where(F.col(n) > 0).select(F.col(doc).alias("doc"), F.col(n).cast("bigint").alias("all"), piece)
    pieces = written(pieces.select("doc", "piece", F.least(F.lit(capacity).cast("bigint"), F.col("all") - F.col("piece") * capacity).alias("size")), "pieces")
    by_size = {r[0]: r[1] for r in pieces.groupBy("size").count().collect()}  # at most `capacity` rows
    planned = plan(by_size, capacity)
    # ranks within a size are counted in chunks, so that a size held by most pieces is no single task's
    chunks = max(1, -(-max(by_size.values(), default=0) // RANKED))
    chunked = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc", "piece"), F.lit(chunks)))
    inner = F.row_number().over(Window.partitionBy("size", "chunk").orderBy("doc", "piece")).cast("bigint") - 1
    ranked = chunked.withColumn("rank", inner)
    if chunks > 1:
        upto = F.sum("m").over(Window.partitionBy("size").orderBy("chunk")) - F.col("m")
        offsets = chunked.groupBy("size", "chunk").agg(F.count("*").alias("m")).select("size", "chunk", upto.alias("offset"))
        ranked = ranked.join(offsets, ["size", "chunk"]).withColumn("rank", F.col("rank") + F.col("offset"))
    placed = ranked.select("doc", "piece", "size", "rank").mapInArrow(lambda b: _placed(b, planned, capacity, step), ", ".join(f"{c} bigint" for c in OUT))
    return placed.withColumnRenamed("doc", doc), planned


def step_report(placed: DataFrame, capacity: int) -> DataFrame:
    """Per step: containers, pieces, tokens, unused tokens and cost."""
    filled = placed.groupBy("step", "container").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("cost"))
    return filled.groupBy("step").agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), (F.count("*") * capacity - F.sum("tokens")).alias("unused"), F.sum("cost").alias("cost"))
