"""Splits that keep related records together (problem 2): hash-to-min components, then weighted rendezvous hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage


def hash_to_min(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of the graph of edges; the component is named by its least node. Edges with a null end are left out.

    Every node tells its cluster to the least node of it, and that least node to all others, until nothing changes; there is
    no limit of rounds. Clusters are rows (v, u), never arrays, so the cluster of a least node is spread over tasks: its
    minimum is partially aggregated, and AQE splits the one hot key of the join. Each round starts from a checkpoint.
    """
    e = edges.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v is not null and u is not null")
    turned = e.select(F.col("u").alias("v"), F.col("v").alias("u"))
    alone = e.select("v", F.col("v").alias("u")).union(e.select(F.col("u").alias("v"), "u"))
    clusters = cut_lineage(e.union(turned).union(alone).distinct())
    while True:
        least = clusters.groupBy("v").agg(F.min("u").alias("m"))
        told = clusters.join(least, "v")
        after = cut_lineage(told.select(F.col("m").alias("v"), "u").union(told.select(F.col("u").alias("v"), F.col("m").alias("u"))).distinct())
        # stable if both hold the same pairs: as sets without repeats, equal in number and without a pair of one only
        same = clusters.count() == after.count() and not after.join(clusters, ["v", "u"], "left_anti").limit(1).count()
        clusters = after
        if same:
            return clusters.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("node"), F.col("m").alias("component"))


def rendezvous(component: Column, shares: dict[str, float], seed: int) -> Column:
    """The split whose weighted score -share / ln(h) is the highest, h being a uniform hash of seed, component and split.

    A component's split depends on nothing but its name, so it stays when others come or go; a new split draws from all alike.
    """
    ranked = []
    for name, share in shares.items():
        h = (F.pmod(F.xxhash64(F.lit(seed), component, F.lit(name)), F.lit(2**52)) + F.lit(0.5)) / F.lit(float(2**52))
        ranked.append(F.struct((F.lit(-float(share)) / F.log(h)).alias("s"), F.lit(name).alias("n")))
    return F.greatest(*ranked)["n"]


def best_seed(sizes: DataFrame, component: str, n: str, shares: dict[str, float], seeds: int) -> int:
    """Of so many seeds the one under which the splits' shares of all records come closest to the wanted ones.

    Rendezvous hashing meets the shares only in expectation, and few large components stray from it. One aggregation, with
    partial sums, tries all seeds; only its sums come to the driver.
    """
    sums = [F.sum(F.when(rendezvous(F.col(component), shares, s) == k, F.col(n)).otherwise(0)).alias(f"{s}_{k}") for s in range(seeds) for k in shares]
    row = sizes.agg(F.sum(n).alias("all"), *sums).first()
    total = row["all"] or 1
    return min(range(seeds), key=lambda s: (max(abs((row[f"{s}_{k}"] or 0) / total - share) for k, share in shares.items()), s))
