"""Summaries of coding and agreement between raters or between coding and predictions.

All statistics are sums over one pass: nothing is collected. Where a ratio has no value (0/0) the result is null, but
precision, recall and F1 are 0 then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens import lexicons as L


def frame_summary(facts: DataFrame) -> DataFrame:
    """(frame, demographic, total_count, num_articles) of the four frames and six groups with a positive total, in fixed order."""
    known = facts.where(F.col("frame_type").isin(*L.FRAMES) & F.col("demographic_group").isin(*L.SUMMARY_GROUPS))
    sums = known.groupBy(F.col("frame_type").alias("frame"), F.col("demographic_group").alias("demographic")).agg(F.sum("count").alias("total_count"), F.countDistinct("article_id").alias("num_articles"))
    place = lambda names, c: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    return sums.where("total_count > 0").orderBy(place(L.FRAMES, "frame"), place(L.SUMMARY_GROUPS, "demographic"))


def totals(facts: DataFrame, *by: str) -> DataFrame:
    """Sum of counts by the given columns, the largest first."""
    return facts.groupBy(*by).agg(F.sum("count").alias("total_count")).orderBy(F.desc_nulls_last("total_count"), *by)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def length_stats(articles: DataFrame) -> DataFrame:
    """Mean characters and words, fewest and most words. Needs content_length and word_count."""
    return articles.agg(F.avg("content_length").alias("mean_chars"), F.avg("word_count").alias("mean_words"), F.min("word_count").alias("min_words"), F.max("word_count").alias("max_words"))


def keyword_totals(articles: DataFrame, content: str = "content") -> DataFrame:
    """(frame, occurrences) of the corpus keywords as substrings, over all articles."""
    from framelens.functions.text import quote

    low = F.lower(F.col(content))
    sums = [F.coalesce(F.sum(F.regexp_count(low, F.lit("|".join(map(quote, terms))))), F.lit(0)).cast("bigint").alias(f) for f, terms in L.CORPUS_KEYWORDS.items()]
    return articles.agg(*sums).unpivot([], list(L.CORPUS_KEYWORDS), "frame", "occurrences")


def merge_with_predictions(articles: DataFrame, predictions: DataFrame, key: str = "article_id") -> DataFrame:
    """Inner join on the key; other columns that both have get the endings _human and _predicted. Repeated keys multiply."""
    both = [c for c in articles.columns if c in predictions.columns and c != key]
    return articles.withColumnsRenamed({c: f"{c}_human" for c in both}).join(predictions.withColumnsRenamed({c: f"{c}_predicted" for c in both}), key, "inner")


def icc(ratings: DataFrame, first: str, second: str) -> DataFrame:
    """One row: ``icc_ref``, with the sum of squares between targets over 2n ratings, and ``icc_2_1``, the textbook
    two-way random-effects coefficient of single ratings. Rows with a null rating are left out."""
    r = ratings.select(F.col(first).cast("double").alias("a"), F.col(second).cast("double").alias("b")).where("a is not null and b is not null")
    s = r.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum("a").alias("sa"),
        F.sum("b").alias("sb"),
        F.sum(F.pow((F.col("a") + F.col("b")) / 2, 2.0)).alias("smm"),
        F.sum(F.pow(F.col("a") - F.col("b"), 2.0) / 2).alias("within"),
    )
    n, m = F.col("n"), (F.col("sa") + F.col("sb")) / 2
    squares = F.col("smm") - m * m / n  # sum of (target mean - grand mean) squared
    between, within = 2 * squares, F.col("within") / n
    ms_r, ms_e_c = 2 * squares / (n - 1), F.col("within")
    ms_c = F.pow(F.col("sa") - F.col("sb"), 2.0) / (2 * n)
    ms_e = (ms_e_c - ms_c) / (n - 1)
    ratio = lambda x, y: F.when(y != 0, x / y)
    return s.select(
        n.cast("bigint").alias("n"),
        F.when(n > 0, ratio(between - within, between + within)).alias("icc_ref"),
        F.when(n > 1, ratio(ms_r - ms_e, ms_r + ms_e + 2 * (ms_c - ms_e) / n)).alias("icc_2_1"),
    )


def frame_flags(df: DataFrame, human: Column, predicted: Column) -> DataFrame:
    """(article_id, frame, human, ml): one row an article and frame, from two arrays of frames."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("frame"), F.coalesce(F.array_contains(human, f), F.lit(False)).alias("human"), F.coalesce(F.array_contains(predicted, f), F.lit(False)).alias("ml")) for f in L.FRAMES)))
    return df.select("article_id", each.alias("x")).select("article_id", "x.frame", "x.human", "x.ml")


def confusion(flags: DataFrame, rollup: bool = False) -> DataFrame:
    """(frame, tp, fp, fn, tn) of each frame; with ``rollup`` of all together too, whose frame is null."""
    h, m = F.col("human"), F.col("ml")
    return (flags.rollup("frame") if rollup else flags.groupBy("frame")).agg(F.count_if(h & m).alias("tp"), F.count_if(~h & m).alias("fp"), F.count_if(h & ~m).alias("fn"), F.count_if(~h & ~m).alias("tn"))


def _rates() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    zero = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    p, r = zero(tp, tp + fp), zero(tp, tp + fn)
    observed = (tp + tn) / n
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    return {"precision": p, "recall": r, "f1": zero(2 * p * r, p + r), "kappa": F.when(chance != 1, (observed - chance) / (1 - chance)), "accuracy": F.when(n > 0, observed)}


def agreement_metrics(flags: DataFrame) -> DataFrame:
    """(metric, value): precision, recall, F1 and kappa of each frame, and overall ones over all frames with accuracy."""
    rates = _rates()
    # one pass for the frames and the whole, whose frame is null
    each = confusion(flags.where("frame is not null"), rollup=True).select("frame", *(c.alias(k) for k, c in rates.items()))
    value = each.unpivot(["frame"], list(rates), "m", "value")
    wanted = F.when(F.col("frame").isNull(), F.col("m") != "kappa").otherwise(F.col("m") != "accuracy")
    return value.where(wanted).select(F.concat_ws("_", F.coalesce("frame", F.lit("overall")), "m").alias("metric"), "value")


def match_accuracy(flags: DataFrame) -> DataFrame:
    """(frame, accuracy): share of equal flags, per frame and (frame null) overall."""
    return flags.rollup("frame").agg(F.avg((F.col("human") == F.col("ml")).cast("int")).alias("accuracy"))


def repeated_measures(cells: DataFrame, conditions: tuple[str, ...], subject: str = "article_id", condition: str = "demographic_group", value: str = "count", by: str = "frame_type") -> DataFrame:
    """One row for each ``by``: analysis of variance of the value over conditions within subjects.

    (by, n, k, ss_conditions, ss_subjects, ss_error, df_conditions, df_error, f, partial_eta2). Every subject of the table is in
    every ``by``; cells that aren't there, or are null, count 0, and cells that repeat add up. Null subjects take no part. f and
    partial_eta2 are null where nothing varies, or with fewer than two subjects. Two passes of sums; nothing is collected.
    """
    k = len(conditions)
    own = cells.where(F.col(subject).isNotNull())
    n = own.agg(F.countDistinct(subject).alias("n"))
    x = [F.coalesce(F.sum(F.when(F.col(condition) == c, F.col(value))), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(conditions)]
    rows = own.where(F.col(by).isNotNull()).groupBy(by, subject).agg(*x)
    cols = [F.col(f"x{i}") for i in range(k)]
    total = sum(cols[1:], cols[0])
    squares = sum((c * c for c in cols[1:]), cols[0] * cols[0])
    sums = rows.groupBy(by).agg(*(F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)), F.sum(total * total).alias("sq_subjects"), F.sum(squares).alias("sq"))
    both = sums.join(F.broadcast(n))  # one row
    s = [F.col(f"s{i}") for i in range(k)]
    size = F.col("n") * F.lit(float(k))
    correction = F.pow(sum(s[1:], s[0]), 2.0) / size
    between = sum((c * c for c in s[1:]), s[0] * s[0]) / F.col("n") - correction
    subjects = F.col("sq_subjects") / float(k) - correction
    error = F.col("sq") - correction - between - subjects
    df1, df2 = F.lit(k - 1), (F.lit(k - 1) * (F.col("n") - 1))
    out = both.select(by, "n", F.lit(k).cast("bigint").alias("k"), between.alias("ss_conditions"), subjects.alias("ss_subjects"), error.alias("ss_error"), df1.cast("bigint").alias("df_conditions"), df2.cast("bigint").alias("df_error"))
    some = (F.col("ss_error") > 1e-9) & (F.col("df_error") > 0)
    return out.withColumn("f", F.when(some, F.col("ss_conditions") / F.col("df_conditions") / (F.col("ss_error") / F.col("df_error")))).withColumn("partial_eta2", F.when(some, F.col("ss_conditions") / (F.col("ss_conditions") + F.col("ss_error"))))
