"""Mixing sources to target weights: hash-random order, distributed prefix sums of token counts, an exact cut per source.

The whole mix is as large as it can be with every source that has text at its share: the source that runs out first, even
with all its repeats, sets the size (``total`` sets a smaller or larger one; sources that run out then stay below their
share). A source is used in whole epochs, and of the last epoch up to the text at which its budget is reached.

Prefix sums need no task that holds a source: texts are put into ranges of their hash-random key, the ranges are summed, the
sums of the ranges before are added, and only within one range are texts put in order.

Defined results: null and blank texts and texts without tokens are left out; equal texts are one text, which belongs to the
document with the smallest key, so that no text is used too often; sources compare without case and outer blanks; a null
source is none; a target source without text has uses 0 and a reached share of 0; repeated target rows of a source count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.llm.packing import sized
from framelens.session import cut, small

#: Texts in a range of keys, on average; a range is put in order by one task.
RANGE_TEXTS = 20_000


def same_source(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?U)^\s+|\s+$", ""))


def chosen(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, source, n_tokens) of the different texts of the target sources."""
    wanted = targets.select(same_source("source").alias("s")).where("s is not null").distinct()
    own = documents.select(key, F.col(text).alias("text"), same_source("source").alias("s")).where(F.col("text").rlike(r"(?U)\S")).join(wanted, "s")
    # equal texts by a hash of the text; neither they nor what is left are shuffled, and only what is left is encoded
    hashed = cut(own.select(key, "s", F.md5("text").alias("h")), "hashes")
    first = hashed.groupBy("h").agg(F.min(F.struct(key, "s")).alias("x")).select("h", F.col(f"x.{key}").alias("_first"))
    repeats = cut(hashed.join(first, "h").where(F.col(key) != F.col("_first")).select(key), "repeats")
    sizes = sized(own.join(small(repeats), key, "left_anti"), key, "text", vocabulary)
    return sizes.join(hashed.select(key, F.col("s").alias("source")), key).where("n_tokens > 0").select(key, "source", "n_tokens")


def budgets(texts: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, budget): one row a target source."""
    t = targets.select(same_source("source").alias("source"), "target_share", "max_repeats").where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    b = t.join(texts.groupBy("source").agg(F.sum("n_tokens").alias("available")), "source", "left").fillna(0, ["available", "target_share", "max_repeats"])
    most = F.col("available") * F.col("max_repeats")
    if total is None:
        # the sum of shares of the sources that have text at all
        able = (F.col("target_share") > 0) & (most > 0)
        size = b.agg(F.min(F.when(able, most / F.col("target_share"))).alias("size")).first()["size"] or 0.0
    else:
        size = float(total)
    return b.withColumn("budget", F.least(F.floor(F.col("target_share") * size + 1e-6), most))


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", total: int | None = None, seed: int = 42, vocabulary: str | None = None) -> DataFrame:
    """(key, source, n_tokens, uses): the texts of the mix and how often each is used (at least once)."""
    return _mixed(documents, targets, key, text, total, seed, vocabulary)[0]


def _mixed(documents, targets, key, text, total, seed, vocabulary):
    texts = cut(chosen(documents, targets, key, text, vocabulary), "texts")
    plan = cut(budgets(texts, targets, total), "budgets")
    ranges = max(1, texts.count() // RANGE_TEXTS)
    order = F.xxhash64(F.col(key), F.lit(seed))
    # ranges of equal width over all longs
    texts = texts.withColumn("order", order).withColumn("range", F.floor((F.col("order").cast("double") + 2.0**63) / 2.0**64 * ranges).cast("int"))
    sums = texts.groupBy("source", "range").agg(F.sum("n_tokens").alias("tokens"))  # sources x ranges rows
    before = sums.withColumn("before", F.sum("tokens").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).select("source", "range", F.coalesce("before", F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "range").orderBy("order", key)
    run = texts.join(before, ["source", "range"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    used = run.join(plan.select("source", "available", "budget", "max_repeats"), "source")
    epochs = F.floor(F.col("budget") / F.col("available"))
    rest = F.col("budget") - epochs * F.col("available")
    # the text that crosses the budget goes in if that comes nearer to it, and may be used once more
    more = (F.col("upto") - F.col("n_tokens") / 2 <= rest) & (rest > 0) & (epochs < F.col("max_repeats"))
    out = used.withColumn("uses", (epochs + F.when(more, 1).otherwise(0)).cast("bigint")).where("uses > 0")
    return out.select(key, "source", "n_tokens", "uses"), plan


def shares(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", total: int | None = None, seed: int = 42, vocabulary: str | None = None) -> DataFrame:
    """Per target source: target and reached share, tokens in the mix, texts used, most uses of one text."""
    used, plan = _mixed(documents, targets, key, text, total, seed, vocabulary)
    by = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("n_texts"), F.max("uses").alias("most_uses"))
    out = plan.select("source", "target_share", "max_repeats", "available").join(by, "source", "left").fillna(0, ["tokens", "n_texts", "most_uses"])
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row a target source
    return out.withColumn("reached_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0))
