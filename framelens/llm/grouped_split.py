"""Splits that keep related records together: hash-to-min components, then weighted rendezvous hashing.

Records are joined through what they share (source, authors). The graph has a node for each shared value, not for each
record: a record with several values links them. Hash-to-min: each node holds a cluster of nodes, first itself and its
neighbours; in each round it sends its cluster to the smallest member, and the smallest member to all of the cluster,
until nothing changes. Clusters are rows (node, member), never a list, so a component with a third of all nodes is many
rows. Every round is written to the shared folder.

Defined results: a null, empty or blank source or author joins nothing; a record without either is a group by itself; a
repeated record counts once, with the values of all its rows; group ids are the smallest record key in the group.
"""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.session import cut, drop_cut

#: Bylines that name nobody.
NOBODY = ("staff", "newsroom", "editorial board")
#: Splits and their shares of the records.
SHARES = {"train": 0.64, "val": 0.16, "test": 0.20}
#: Groups with more than one record in so many are placed one by one, the largest first; there are at most as many groups.
LARGE = 1000
#: The weights of the hashing are corrected so often at most, until every split is within CLOSE of its share of all records.
ROUNDS, CLOSE = 8, 0.0005


def squeezed(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", ""))


def outer_trimmed(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def names_of(byline: Column) -> Column:
    """The names of a byline, in lower case, without 'By' and extra blanks."""
    bare = F.regexp_replace(squeezed(byline), r"^by\b[ :]*", "")
    parts = F.transform(F.split(bare, r"(?: and )|;|&"), lambda x: F.regexp_replace(F.trim(x), r"^by ", ""))
    return F.array_distinct(F.filter(parts, lambda x: (x != "") & ~x.isin(*NOBODY)))


def values_of(articles: DataFrame, mapping: DataFrame, key: str = "article_id") -> DataFrame:
    """(key, value): each shared value of each record once. Sources go through the mapping."""
    known = mapping.select(outer_trimmed(F.col("variant")).alias("s"), outer_trimmed(F.col("source")).alias("to")).where("s is not null").groupBy("s").agg(F.min("to").alias("to"))
    rows = articles.select(F.col(key).alias("key"), outer_trimmed(F.col("source")).alias("s"), names_of(F.col("author")).alias("names")).where("key is not null")
    # a hot source is one row here: map each different source, not each record
    mapped = rows.select("s").where("s is not null and s <> ''").distinct().join(known, "s", "left").select("s", F.coalesce("to", "s").alias("source"))
    sources = rows.join(mapped, "s").select("key", F.concat(F.lit("s:"), "source").alias("value"))
    authors = rows.select("key", F.explode("names").alias("n")).select("key", F.concat(F.lit("a:"), "n").alias("value"))
    return sources.unionByName(authors).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) by hash-to-min; label is the smallest node of the component. edges: (x, y), of any type that has an
    order; any order, loops allowed."""
    both = edges.select(F.col("x").alias("v"), F.col("y").alias("u")).unionByName(edges.select(F.col("y").alias("v"), F.col("x").alias("u")))
    loops = both.select("v", F.col("v").alias("u"))
    clusters = cut(both.unionByName(loops).distinct(), "clusters")
    seen = None
    for _ in range(rounds):
        least = clusters.groupBy("v").agg(F.min("u").alias("m"))
        held = clusters.join(least, "v")
        sent = held.select(F.col("m").alias("v"), "u").unionByName(held.select(F.col("u").alias("v"), F.col("m").alias("u")))
        before, clusters = clusters, cut(sent.distinct(), "clusters")
        drop_cut(before)
        now = clusters.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("sum")).first()
        if now == seen:
            return clusters.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("label"))
        seen = now
    raise RuntimeError("hash-to-min did not settle")


def groups(articles: DataFrame, mapping: DataFrame, key: str = "article_id") -> DataFrame:
    """(key, group_id) of every record."""
    values = cut(values_of(articles, mapping, key).select("key", F.col("value").alias("node")), "values")
    # a record's values are few: its source and the names in its byline
    first = values.groupBy("key").agg(F.min("node").alias("x"))
    edges = values.join(first, "key").select("x", F.col("node").alias("y")).distinct()
    labels = components(edges)
    labelled = cut(first.join(labels, first["x"] == labels["node"]).select("key", "label"), "labels")
    ids = labelled.groupBy("label").agg(F.min("key").alias("group_id"))
    grouped = labelled.join(ids, "label").select("key", "group_id")
    every = articles.select(F.col(key).alias("key")).where("key is not null").distinct()
    return every.join(grouped, "key", "left").select(F.col("key").alias(key), F.coalesce("group_id", "key").alias("group_id"))


def drawn(weights: dict[str, float], seed: int) -> Column:
    """Weighted rendezvous: the split with the least -ln(u) / weight, u a hash of group and split in (0, 1)."""
    scores = []
    for s, w in weights.items():
        u = (F.shiftrightunsigned(F.xxhash64("group_id", F.lit(s), F.lit(seed)), 11).cast("double") + 0.5) / float(2**53)
        scores.append(F.struct((-F.log(u) / F.lit(w) if w > 0 else F.lit(float("inf"))).alias("score"), F.lit(s).alias("split")))
    return F.array_min(F.array(*scores))["split"]


def _unit(group: str, split: str, seed: int) -> float:
    """A hash of group and split in (0, 1)."""
    return ((xxhash.xxh3_64_intdigest(f"{group}|{split}|{seed}") >> 11) + 0.5) / float(2**53)


def splits(grouped: DataFrame, shares: dict[str, float] = SHARES, key: str = "article_id", seed: int = 42) -> DataFrame:
    """(key, group_id, split), all by weighted rendezvous hashing, whose weights are what the splits still lack.

    Large groups, at most LARGE of them, go first and one by one, so that each changes the weights for the next and none goes
    where it doesn't fit; the others together, with weights corrected by what hashing then gives."""
    grouped = cut(grouped, "groups")
    sizes = cut(grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    total = grouped.count()
    large = sizes.where(F.col("n") * LARGE > total).orderBy(F.desc("n"), "group_id").collect()  # fewer than LARGE rows
    room = {s: share * total for s, share in shares.items()}
    placed = []
    for r in large:
        # among the splits that have room for it; the roomiest if none has
        fit = [s for s in room if room[s] >= r["n"]] or [max(room, key=lambda s: room[s])]
        to = min(fit, key=lambda s: -math.log(_unit(r["group_id"], s, seed)) / max(room[s], 1e-9))
        room[to] -= r["n"]
        placed.append((r["group_id"], to))
    spark = grouped.sparkSession
    fixed = spark.createDataFrame(placed, "group_id string, placed string")
    rest = sizes.join(F.broadcast(fixed), "group_id", "left_anti")
    targets = {s: max(0.0, x) for s, x in room.items()}
    weights = dict(targets)
    for _ in range(ROUNDS):
        got = {s: 0 for s in targets} | {r["split"]: r["n"] for r in rest.groupBy(drawn(weights, seed).alias("split")).agg(F.sum("n").alias("n")).collect()}
        if max(abs(got[s] - targets[s]) for s in targets) <= CLOSE * total:
            break
        # a slightly changed weight moves only the groups whose scores are nearly equal
        weights = {s: weights[s] * (targets[s] / got[s] if got[s] else 2.0) if targets[s] else 0.0 for s in targets}
    assigned = sizes.join(F.broadcast(fixed), "group_id", "left").select("group_id", F.coalesce("placed", drawn(weights, seed)).alias("split"))
    return grouped.join(assigned, "group_id").select(key, "group_id", "split")
