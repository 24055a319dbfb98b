"""Filling containers of fixed capacity: best-fit decreasing with a segment tree over the remaining capacities.

Items are dealt to shards at random (by a hash of their key), so that each shard is packed by one task with a bounded
number of items (ITEMS_PER_SHARD) whatever their sizes or keys. A shard's last containers are the only ones that the
sharding leaves less full: the items of containers that are less than FULL are dealt and packed once more, a container a shard or
so, and what is left of the loss is a few containers in ten thousands. Only keys and sizes are moved, no text.

Defined results: null, empty and blank texts are no items; a text longer than the capacity is cut into parts of the full
capacity and a rest, and no other text is cut; a text whose size is 0 is no item; keys are unique.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm import tokens
from framelens.llm.rows import map_rows
from framelens.session import cut, ship, small, spread

CAPACITY = 2048
ITEMS_PER_SHARD = 40_000
#: Containers that are used less than this are emptied and packed again, if there is more than one shard.
FULL = 0.98


class TightestBin:
    """Segment tree over remaining capacities 0..capacity: which is the smallest one, at or above a size, with an open bin."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, remaining: int, bin_no: int) -> None:
        self.bins[remaining].append(bin_no)
        i = remaining + self.leaves
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(remaining capacity, bin) of the tightest bin that has room for size, or None. The bin is taken out."""
        i, tree = size + self.leaves, self.any
        while not tree[i]:
            while i & 1:  # a right child, or the end of a row: go up
                i >>= 1
                if not i:
                    return None
            i += 1
            if not i & (i - 1):
                return None  # past the last leaf
        while i < self.leaves:
            i = 2 * i if tree[2 * i] else 2 * i + 1
        remaining = i - self.leaves
        found = self.bins[remaining].pop()
        if not self.bins[remaining]:
            tree[i] = 0
            i >>= 1
            while i and not (tree[2 * i] or tree[2 * i + 1]):
                tree[i] = 0
                i >>= 1
        return remaining, found


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin number of each item. Sizes must be between 1 and capacity."""
    tree, out, n = TightestBin(capacity), [0] * len(sizes), 0
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        hit = tree.take(sizes[k])
        remaining, bin_no = hit if hit else (capacity, n)
        n += hit is None
        out[k] = bin_no
        if remaining > sizes[k]:
            tree.put(remaining - sizes[k], bin_no)
    return out


def sized(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, n_tokens) of each text that isn't null or blank, by the whole text."""
    path = tokens.vocabulary_path(vocabulary)

    def run(batches):
        encode = tokens.encoder(path).encode_ordinary
        for b in batches:
            yield {"k": b["k"], "n_tokens": [len(encode(t)) for t in b["t"]]}

    df = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull() & F.col("t").rlike(r"(?U)\S"))
    return map_rows(spread(df), run, f"k {dict(documents.dtypes)[key]}, n_tokens bigint").withColumnRenamed("k", key)


def pack(items: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, per_shard: int = ITEMS_PER_SHARD) -> DataFrame:
    """(container, key, part, start, size): which items, or parts of oversized ones, go into which container."""
    ship(items.sparkSession)
    kind = dict(items.dtypes)[key]
    n_parts = F.ceil(F.col(size) / capacity).cast("int")
    parts = items.where(F.col(size) > 0).select(key, F.col(size).alias("whole"), F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part"))
    parts = parts.select(key, "part", (F.col("part") * F.lit(capacity)).cast("bigint").alias("start"), F.least(F.lit(capacity), F.col("whole") - F.col("part") * capacity).cast("bigint").alias("size"))
    n = parts.count()
    shards = max(1, math.ceil(n / per_shard))
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64(key, "part"), F.lit(shards)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "part"], kind="stable")  # the same result for any order of rows
        pdf["bin"] = best_fit_decreasing(pdf["size"].tolist(), capacity)
        return pdf

    schema = f"{key} {kind}, part int, start bigint, size bigint, shard int, bin int"
    packed = dealt.groupBy("shard").applyInPandas(run, schema)
    if shards > 1:
        packed = cut(packed, "packed")
        emptied = small(packed.groupBy("shard", "bin").agg(F.sum("size").alias("used")).where(F.col("used") < FULL * capacity).select("shard", "bin"))
        loose = packed.join(emptied, ["shard", "bin"], "left_semi").drop("bin")
        again = max(1, math.ceil(loose.count() / per_shard))
        repacked = loose.withColumn("shard", (F.lit(shards) + F.pmod(F.xxhash64(key, "part", F.lit(1)), F.lit(again))).cast("int")).select(key, "part", "start", "size", "shard")
        packed = packed.join(emptied, ["shard", "bin"], "left_anti").unionByName(repacked.groupBy("shard").applyInPandas(run, schema))
    return packed.select(F.concat_ws("-", "shard", "bin").alias("container"), key, "part", "start", "size")


def containers(documents: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    return pack(cut(sized(documents, key, text, vocabulary), "sizes"), key, "n_tokens", capacity)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens, the share of the capacity that is used, and the least number there could be."""
    bins = packed.groupBy("container").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("items"))
    total = bins.agg(F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("items"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"), F.max("used").alias("fullest"))
    return total.withColumn("used_share", F.when(F.col("n_containers") > 0, F.col("n_tokens") / (F.col("n_containers") * capacity))).withColumn("least_containers", F.ceil(F.col("n_tokens") / capacity))
