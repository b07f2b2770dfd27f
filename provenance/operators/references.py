"""References to keys that a parent table does not hold (problem 5).

A Bloom filter of the parent keys, cut into blocks of 512 bits, is an ordinary table (block, w0 … w7): it is built by
bit_or with partial aggregation and asked by an equi-join on the block, all of it in the JVM. What it denies is an orphan
for certain; only what it lets pass is verified by an exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8  # of 64 bits, one bit set in each
BITS_A_KEY = 16
#: Above so many keys (0.5 million blocks, some 64 MB in a broadcast) the filter is joined by shuffle.
BROADCAST_KEYS = 16_000_000


def _place(key: Column, blocks: int) -> list[Column]:
    """The block of a key, then the bit it sets in each word."""
    h = F.xxhash64(key, F.lit(7))
    return [F.pmod(F.xxhash64(key), F.lit(blocks)).alias("__block"), *(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")).alias(f"__b{i}") for i in range(WORDS))]


def _shifted(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    block, *bits = _place(key, blocks)
    return block, bits


def bloom_filter(keys: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """(__block, __w0 … __w7) and the number of blocks, sized by n_keys."""
    blocks = max(1, -(-n_keys * BITS_A_KEY // (64 * WORDS)))
    block, bits = _shifted(F.col(key), blocks)
    return keys.where(F.col(key).isNotNull()).select(block, *bits).groupBy("__block").agg(*(F.bit_or(f"__b{i}").alias(f"__w{i}") for i in range(WORDS))), blocks


def split_by_filter(refs: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """refs with may_exist: false proves that no parent has the key. Null keys are never there."""
    n = parents.count()
    filt, blocks = bloom_filter(parents, parent_key, n)
    filt = F.broadcast(filt) if n <= BROADCAST_KEYS else filt
    block, bits = _shifted(F.col(key), blocks)
    let_pass = F.lit(True)
    for i in range(WORDS):
        let_pass = let_pass & (F.col(f"__w{i}").bitwiseAND(F.col(f"__b{i}")) == F.col(f"__b{i}"))
    names = refs.columns
    return refs.select("*", block, *bits).join(filt, "__block", "left").select(*names, F.coalesce(let_pass, F.lit(False)).alias("may_exist"))


def orphans(refs: DataFrame, key: str, at: str, parents: DataFrame, parent_key: str, since: str, until: str) -> DataFrame:
    """The refs whose key no parent row held at the time `at`: since <= at < until, until null for still. refs: any columns.

    Null keys and null times are orphans if given: leave them out before, where they are no references. A parent that never
    began (since null) covers nothing. The exact join has no hint: Catalyst broadcasts the parents only below its own
    threshold, and else AQE splits a hot key on the side of the references.
    """
    names = refs.columns
    if "may_exist" in names:
        raise ValueError("refs must not have a column named may_exist")
    asked = split_by_filter(refs, key, parents, parent_key)
    held = parents.select(F.col(parent_key).alias("__held_key"), F.col(since).alias("__held_since"), F.col(until).alias("__held_until")).where("__held_key is not null")
    covers = (F.col(key) == F.col("__held_key")) & (F.col("__held_since") <= F.col(at)) & (F.col("__held_until").isNull() | (F.col(at) < F.col("__held_until")))
    denied = asked.where(~F.col("may_exist")).select(*names)
    unheld = asked.where("may_exist").select(*names).join(held, covers, "left_anti")
    return denied.unionByName(unheld)


def per_period(found: DataFrame, at: str, *by: str) -> DataFrame:
    """The number of found rows per `by` and month (yyyy-MM)."""
    return found.groupBy(*by, F.date_format(at, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
