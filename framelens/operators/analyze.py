"""Frame analysis of articles: units of text, a detector over them, and the results gathered per article."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens import lexicons as L
from framelens.functions import segments as G
from framelens.functions import text as X
from framelens.operators.detect import Detector, detect


def segment_for_analysis(articles: DataFrame, cleaned: str = "cleaned_content", content: str = "content") -> DataFrame:
    """articles with sentences, paragraphs, windows, quotes, leadership_segments and metadata, of the cleaned text if there."""
    sources = [F.col(c) for c in (cleaned, content) if c in articles.columns]
    df = articles.withColumn("_text", F.coalesce(*sources)).withColumn("sentences", X.sentences(F.col("_text")))
    t = F.col("_text")
    df = df.withColumn("paragraphs", X.paragraphs(t)).withColumn("windows", G.sliding_windows(F.col("sentences"))).withColumn("quotes", G.quotes(t)).withColumn("leadership_segments", G.keyword_segments(t, size=150))
    meta = F.struct(
        F.size("sentences").cast("bigint").alias("total_sentences"),
        F.size("paragraphs").cast("bigint").alias("total_paragraphs"),
        F.size("windows").cast("bigint").alias("total_windows"),
        F.size("quotes").cast("bigint").alias("total_quotes"),
        G.average_words(F.col("sentences")).alias("avg_sentence_length"),
    )
    return df.withColumn("metadata", meta).drop("_text")


def units(articles: DataFrame, text: str = "content", windows: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(article_id, unit_no, text): windows of sentences, or the whole text as one unit. ``keep``: columns of the article to carry."""
    if not windows:
        return articles.select("article_id", F.lit(0).alias("unit_no"), F.col(text).alias("text"), *keep)
    # the sentences are a column of their own, so that they are not cut again for each window
    sents = articles.select("article_id", X.sentences(F.col(text)).alias("s"), *keep)
    w = sents.select("article_id", F.explode(G.sliding_windows(F.col("s"))).alias("w"), *keep)
    return w.select("article_id", F.col("w.window_id").alias("unit_no"), F.col("w.text").alias("text"), *keep)


class FrameAnalyzer:
    """Frames, scores and groups of each article.

    ``preprocess`` takes the groups of the cleaned article for each of its units (else those a unit mentions by substring);
    ``segment`` cuts the raw article into windows.
    """

    def __init__(self, detector: Detector, preprocess: bool = False, segment: bool = False):
        self.detector, self.preprocess, self.segment = detector, preprocess, segment

    def unit_results(self, articles: DataFrame) -> DataFrame:
        """(article_id, unit_no, text, prediction, demographics)"""
        own = X.mentioned_people(F.col("text"))
        if not self.preprocess:
            return detect(units(articles, "content", self.segment), self.detector).withColumn("demographics", own)
        cleaned = articles.select("article_id", "content", X.clean_text(F.col("content")).alias("_cleaned"))
        groups = cleaned.select("article_id", "content", "_cleaned", F.map_keys(X.demographics(F.col("_cleaned"))).alias("_groups"))
        u = detect(units(groups, "content" if self.segment else "_cleaned", self.segment, ("_groups",)), self.detector)
        return u.withColumn("demographics", F.when(F.size("_groups") > 0, F.col("_groups")).otherwise(own)).drop("_groups")

    def analyze(self, articles: DataFrame, detailed: bool = True) -> DataFrame:
        """One row an article: frames_detected, frame_scores, demographics, frame_counts, segments_analyzed, detailed_results.

        Means and counts are summed up before the shuffle; an article's units are only gathered if ``detailed``.
        """
        u = self.unit_results(articles)
        means = F.create_map(*(x for f in L.FRAMES for x in (F.lit(f), F.coalesce(F.avg(F.try_element_at("prediction.scores", F.lit(f))), F.lit(0.0)))))
        frame_n = F.create_map(*(x for f in L.FRAMES for x in (F.lit(f), F.count_if(F.array_contains("prediction.frames", f)))))
        groups = sorted({*L.GROUP_PATTERNS, "women_of_color", "white_men", "white_women", "men_of_color"})
        group_n = F.create_map(*(x for g in groups for x in (F.lit(g), F.count_if(F.array_contains("demographics", g)))))
        positive = lambda m: F.map_filter(m, lambda _, v: v > 0)
        aggs = [means.alias("frame_scores"), positive(frame_n).alias("_f"), positive(group_n).alias("_g"), F.count(F.lit(1)).alias("segments_analyzed")]
        if detailed:
            aggs.append(F.array_sort(F.collect_list(F.struct("unit_no", "text", "prediction", "demographics")), lambda a, b: a["unit_no"] - b["unit_no"]).alias("_units"))
        out = u.groupBy("article_id").agg(*aggs)
        cols = [
            "article_id",
            F.array_sort(F.map_keys("_f")).alias("frames_detected"),
            "frame_scores",
            F.array_sort(F.map_keys("_g")).alias("demographics"),
            F.struct(F.col("_f").alias("frames"), F.col("_g").alias("demographics")).alias("frame_counts"),
            "segments_analyzed",
        ]
        if detailed:
            each = F.transform("_units", lambda x: F.struct(x["text"].alias("text"), x["prediction"]["frames"].alias("frames"), x["prediction"]["scores"].alias("scores"), x["demographics"].alias("demographics")))
            cols.append(F.when(F.size("_units") > 1, each).alias("detailed_results"))
        return out.select(*cols)

    def summary(self, articles: DataFrame) -> DataFrame:
        """(frame, n_articles, mean_score) over all articles."""
        a = self.analyze(articles, detailed=False)
        rows = a.select(F.explode(F.transform(F.map_entries("frame_scores"), lambda e: F.struct(e["key"].alias("frame"), e["value"].alias("score"), F.array_contains("frames_detected", e["key"]).alias("hit")))).alias("x"))
        return rows.groupBy(F.col("x.frame").alias("frame")).agg(F.count_if("x.hit").alias("n_articles"), F.avg("x.score").alias("mean_score"))
