"""The analysis queries, over whole tables, each article once (its latest row)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelens import lexicons as L
from framelens.functions import features as E
from framelens.functions import language as N
from framelens.functions import segments as G
from framelens.functions import text as X
from framelens.operators import analyze as A
from framelens.operators import corpus as C
from framelens.operators import detect as D
from framelens.operators import evaluate as V
from framelens.session import spread, table
from framelens.sources import articles as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def articles(spark: SparkSession, sf_dir: str, *columns: str, light: bool = False) -> DataFrame:
    """The latest row of each article, of the columns needed only.

    Work on contents is spread over all cores where the table is so small that it is read by fewer, unless it is ``light``.
    """
    read = table(spark, sf_dir, "sample_articles").select("article_id", "ingested_at", *columns)
    rows = C.latest(read)
    return spread(rows, like=read) if "content" in columns and not light else rows


def md5(c: Column | str) -> Column:
    return F.md5(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def joined(c: Column | str) -> Column:
    return F.array_join(c, ",")


# --- corpus ---------------------------------------------------------------------------------------------------------


@query
def source_counts(spark, sf_dir):
    return articles(spark, sf_dir, "source").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query
def canonical_sources(spark, sf_dir):
    a = C.normalised_source(articles(spark, sf_dir, "source"), table(spark, sf_dir, "source_mapping"))
    return a.groupBy(F.lower("canonical_source").alias("canonical_source")).agg(F.count(F.lit(1)).alias("n"))


@query
def article_lengths(spark, sf_dir):
    return C.load_articles(articles(spark, sf_dir, "content", light=True)).select("article_id", "content_length", "word_count")


@query
def source_filter(spark, sf_dir):
    """Articles of one source: the filter reaches the scan."""
    one = table(spark, sf_dir, "sample_articles").where("source = 'Shamidun Ledger'")
    return C.load_articles(C.latest(one.select("article_id", "ingested_at", "source", "content"))).select("article_id", "source", "content_length", "word_count")


@query
def length_stats(spark, sf_dir):
    s = V.length_stats(C.load_articles(articles(spark, sf_dir, "content", light=True)))
    return s.select(F.round("mean_chars", 6).alias("mean_chars"), F.round("mean_words", 6).alias("mean_words"), "min_words", "max_words")


@query
def document_lengths(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.char_length("text").cast("bigint").alias("content_length"), F.when(F.col("text").isNotNull(), X.word_count(F.col("text"))).alias("word_count"))


@query
def coding_facts(spark, sf_dir):
    return C.coding_facts(articles(spark, sf_dir, "source", "human_coding"))


@query
def parsed_coding(spark, sf_dir):
    """Number of coded groups of each of the four frames, 0 where a frame is absent."""
    a = articles(spark, sf_dir, "human_coding").select("article_id", C.parse_coding(F.col("human_coding")).alias("c"))
    return a.select("article_id", *(F.greatest(F.size(F.try_element_at("c", F.lit(f))), F.lit(0)).cast("bigint").alias(f) for f in L.FRAMES))


@query
def validation_report(spark, sf_dir):
    return C.validation_summary(articles(spark, sf_dir, "source", "date", "content", "human_coding", light=True))


@query
def validation_issues(spark, sf_dir):
    return C.issues(articles(spark, sf_dir, "content", "human_coding", light=True))


@query
def validation_counts(spark, sf_dir):
    """Articles of each source, annotations of each frame and group."""
    return C.validation_counts(articles(spark, sf_dir, "source", "human_coding"))


@query
def incomplete_articles(spark, sf_dir):
    """Rows as delivered that lack a required field."""
    return S.incomplete(table(spark, sf_dir, "sample_articles")).select("article_id", joined("missing").alias("missing")).distinct()


@query
def quality_issues(spark, sf_dir):
    return C.quality_issues(articles(spark, sf_dir, "content"))


@query
def languages(spark, sf_dir):
    """The language of each article by script and function words, with its score."""
    a = articles(spark, sf_dir, "content").select("article_id", N.language(F.col("content")).alias("l"))
    return a.select("article_id", "l.lang", F.round("l.score", 6).alias("score"))


@query
def first_articles(spark, sf_dir):
    """The first five articles by id: a limit is the point."""
    return C.head(articles(spark, sf_dir, "source", "title")).select("article_id", "source", "title")


@query
def fold_assignment(spark, sf_dir):
    return C.folds(articles(spark, sf_dir)).select("article_id", F.col("fold").cast("bigint").alias("fold"))


@query
def split_sizes(spark, sf_dir):
    return C.train_val_test(articles(spark, sf_dir)).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query
def split_assignment(spark, sf_dir):
    return C.train_val_test(articles(spark, sf_dir)).select("article_id", "split")


@query
def stratified_split(spark, sf_dir):
    a = articles(spark, sf_dir, "source").withColumn("stratum", F.coalesce(F.lower(F.trim("source")), F.lit("")))
    return C.train_val_test(a, by="stratum").groupBy("stratum", "split").agg(F.count(F.lit(1)).alias("n"))


@query
def article_batches(spark, sf_dir):
    """Slices of 32 articles of each source, by id."""
    a = articles(spark, sf_dir, "source").withColumn("stratum", F.coalesce(F.lower(F.trim("source")), F.lit("")))
    return C.batches(a, 32, "article_id", "stratum").groupBy("stratum", "batch").agg(F.count(F.lit(1)).alias("n"))


@query
def current_splits(spark, sf_dir):
    """Articles of each split in use, whatever its spelling."""
    name = F.lower(F.trim("split"))
    s = table(spark, sf_dir, "article_splits").select("article_id", F.when(name == "validation", "val").otherwise(name).alias("split")).distinct()
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# --- text -----------------------------------------------------------------------------------------------------------


@query
def clean_text_stats(spark, sf_dir):
    a = articles(spark, sf_dir, "content", light=True).select("article_id", X.clean_text(F.col("content")).alias("t"))
    return a.select("article_id", F.char_length("t").cast("bigint").alias("cleaned_length"), F.when(F.col("t").isNotNull(), X.word_count(F.col("t"))).alias("cleaned_words"), md5("t").alias("cleaned_md5"))


@query
def sentence_counts(spark, sf_dir):
    a = articles(spark, sf_dir, "content", light=True).where("content is not null").select("article_id", X.sentences(F.col("content")).alias("s"))
    return a.select("article_id", F.size("s").cast("bigint").alias("n_sentences"), md5(F.array_join("s", "|")).alias("sentences_md5"))


@query
def paragraph_counts(spark, sf_dir):
    a = articles(spark, sf_dir, "content", light=True).where("content is not null").select("article_id", X.paragraphs(F.col("content")).alias("p"))
    return a.select("article_id", F.size("p").cast("bigint").alias("n_paragraphs"), md5(F.array_join("p", "|")).alias("paragraphs_md5"))


@query
def sliding_windows(spark, sf_dir):
    a = articles(spark, sf_dir, "content").where("content is not null").select("article_id", X.sentences(F.col("content")).alias("s"))
    a = a.select("article_id", F.explode(G.sliding_windows(F.col("s"))).alias("w"))
    return a.select("article_id", F.col("w.window_id").cast("bigint").alias("window_id"), F.col("w.start_idx").cast("bigint").alias("start_idx"), F.col("w.end_idx").cast("bigint").alias("end_idx"), md5("w.text").alias("text_md5"))


@query
def segment_metadata(spark, sf_dir):
    a = A.segment_for_analysis(articles(spark, sf_dir, "content").where("content is not null"))
    return a.select("article_id", "metadata.total_sentences", "metadata.total_paragraphs", "metadata.total_windows", "metadata.total_quotes", F.round("metadata.avg_sentence_length", 6).alias("avg_sentence_length"))


@query
def keyword_totals(spark, sf_dir):
    return V.keyword_totals(articles(spark, sf_dir, "content"))


@query
def leadership_contexts(spark, sf_dir):
    a = articles(spark, sf_dir, "content").select("article_id", F.explode(X.leadership_contexts(F.col("content"))).alias("c"))
    return a.select("article_id", "c.term", F.col("c.start").cast("bigint").alias("ctx_start"), F.col("c.end").cast("bigint").alias("ctx_end"), md5("c.context").alias("context_md5"))


@query
def demographic_hits(spark, sf_dir):
    a = articles(spark, sf_dir, "content").select("article_id", F.explode(X.demographics(F.col("content"))).alias("grp", "hits"))
    return a.select("article_id", "grp", F.size("hits").cast("bigint").alias("n"), joined("hits").alias("hits"))


@query
def intersectional_flags(spark, sf_dir):
    a = articles(spark, sf_dir, "content").where("content is not null").select("article_id", F.map_keys(X.demographics(F.col("content"))).alias("g"))
    return a.select("article_id", *(F.array_contains("g", g).cast("int").alias(g) for g in ("women_of_color", "white_men", "white_women", "men_of_color")))


@query
def simple_demographics(spark, sf_dir):
    a = articles(spark, sf_dir, "content", light=True).where("content is not null")
    return a.select("article_id", joined(X.simple_demographics(F.col("content"))).alias("groups"))


@query
def statistics_extract(spark, sf_dir):
    a = articles(spark, sf_dir, "content").select("article_id", F.explode(X.statistics(F.col("content"))).alias("s"))
    return a.select("article_id", "s.type", "s.value", "s.direction", md5("s.context").alias("context_md5"))


@query
def frame_candidates(spark, sf_dir):
    a = articles(spark, sf_dir, "content").select("article_id", X.clean_text(F.col("content")).alias("t"))
    a = a.select("article_id", F.explode(X.frame_candidates(F.col("t"))).alias("frame", "c"))
    return a.select("article_id", "frame", F.size("c").cast("bigint").alias("n"), md5(_plain_letters(F.array_join("c", "|"))).alias("contexts_md5"))


def _plain_letters(c: Column) -> Column:
    """Letters beyond ASCII as z: the other engine finds whole words so."""
    return F.regexp_replace(c, r"[^\x00-\x7F\P{L}]", "z")


@query
def frame_templates(spark, sf_dir):
    """Wordings of the frames that an article has."""
    a = articles(spark, sf_dir, "content").select("article_id", F.explode(N.frame_templates(F.col("content"))).alias("t"))
    return a.select("article_id", "t.frame", "t.template")


@query
def quotes(spark, sf_dir):
    a = articles(spark, sf_dir, "content").select("article_id", F.explode(G.quotes(F.col("content"))).alias("q"))
    return a.select("article_id", F.col("q.pattern_id").cast("bigint").alias("pattern_id"), "q.text", "q.attribution", md5("q.full_match").alias("match_md5"))


@query
def keyword_segments(spark, sf_dir):
    a = articles(spark, sf_dir, "content").select("article_id", F.explode(G.keyword_segments(F.col("content"), size=150)).alias("s"))
    return a.select("article_id", "s.keyword", F.col("s.keyword_position").cast("bigint").alias("keyword_position"), F.col("s.start").cast("bigint").alias("seg_start"), F.col("s.end").cast("bigint").alias("seg_end"), md5("s.text").alias("text_md5"))


@query
def training_examples(spark, sf_dir):
    t = C.training_examples(articles(spark, sf_dir, "content", "human_coding"))
    return t.select("article_id", md5("text").alias("text_md5"), joined(F.array_sort("demographics")).alias("demographics"), joined(F.array_sort(F.coalesce("labels", F.array().cast("array<string>")))).alias("labels"))


@query
def exemplar_counts(spark, sf_dir):
    """Exemplars found by the coding rules, summed per frame and group."""
    e = C.exemplars(articles(spark, sf_dir, "content"))
    return e.groupBy("frame_type", "demographic_group").agg(F.sum("exemplars").alias("exemplars"), F.count(F.lit(1)).alias("n_articles"))


@query
def preprocessed(spark, sf_dir):
    """The whole preprocessing chain, summed up per article."""
    p = C.preprocess(articles(spark, sf_dir, "source", "date", "title", "content", "human_coding").where("content is not null"))
    sizes = ("leadership_contexts", "statistics", "paragraphs")
    candidates = F.concat_ws("|", *(F.coalesce(F.array_join(F.try_element_at("frame_candidates", F.lit(f)), "|"), F.lit("")) for f in L.FRAMES))
    hashes = {"cleaned": F.col("cleaned_content"), "sentences": F.array_join("sentences", "|"), "paragraphs": F.array_join("paragraphs", "|"), "candidates": _plain_letters(candidates)}
    return p.select("article_id", "word_count", "sentence_count", *(md5(v).alias(f"{k}_md5") for k, v in hashes.items()), *(F.size(c).cast("bigint").alias(f"n_{c}") for c in sizes), joined(F.array_sort(F.map_keys("demographics_found"))).alias("demographics"), joined(F.array_sort(F.map_keys("frame_candidates"))).alias("candidates"))


# --- features -------------------------------------------------------------------------------------------------------


def _features(spark, sf_dir, *kinds: str) -> DataFrame:
    a = articles(spark, sf_dir, "content").where("content is not null")
    f = E.with_features(a, "content", kinds, keep=["article_id"]) if kinds else E.with_features(a, "content", keep=["article_id"])
    cols = []
    for name, kind in f.dtypes:
        c = F.col(name)
        if kind == "array<double>":
            c = F.round(F.aggregate(c, F.lit(0.0), lambda a, b: a + b), 6).alias("stats_percentage_sum")
        elif kind == "double":
            c = F.round(c, 6).alias(name)
        elif kind == "int":
            c = c.cast("bigint").alias(name)
        cols.append(c)
    return f.select(*cols)


@query
def lexical_features(spark, sf_dir):
    return _features(spark, sf_dir, "lexical")


@query
def demographic_features(spark, sf_dir):
    return _features(spark, sf_dir, "demographic")


@query
def linguistic_features(spark, sf_dir):
    return _features(spark, sf_dir, "linguistic")


@query
def statistical_features(spark, sf_dir):
    return _features(spark, sf_dir, "statistical")


@query
def context_features(spark, sf_dir):
    return _features(spark, sf_dir, "context")


@query
def all_features(spark, sf_dir):
    return _features(spark, sf_dir)


@query
def multihot_labels(spark, sf_dir):
    a = articles(spark, sf_dir, "human_coding").select("article_id", E.multi_hot(C.coded_frames(F.col("human_coding"))).alias("y"))
    return a.select("article_id", *(F.get("y", F.lit(i)).cast("bigint").alias(f) for i, f in enumerate(L.FRAMES)))


@query
def feature_vectors(spark, sf_dir):
    """Number of features that are not 0, and their sum in millionths weighted by the places of their names, from the assembled vectors."""
    from pyspark.ml.functions import vector_to_array

    a = articles(spark, sf_dir, "content").where("content is not null")
    names = E.numeric_features()
    places = [sorted(names).index(n) + 1 for n in names]
    v = E.feature_vectors(a.select("article_id", "content")).select("article_id", vector_to_array("features").alias("x"))
    return v.select("article_id", F.size(F.filter("x", lambda y: y != 0)).cast("bigint").alias("n_nonzero"), F.size("x").cast("bigint").alias("n_features"), F.aggregate(F.zip_with("x", F.array(*map(F.lit, places)), lambda y, i: F.round(F.round(y, 6) * 1_000_000).cast("bigint") * i), F.lit(0).cast("bigint"), lambda n, y: n + y).alias("millionths"))


# --- detection and analysis -----------------------------------------------------------------------------------------


def _scores(col: str) -> list[Column]:
    return [F.round(F.try_element_at(col, F.lit(f)), 6).alias(f) for f in L.FRAMES]


@query
def mock_predictions(spark, sf_dir):
    a = articles(spark, sf_dir, "content", light=True).where("content is not null")
    p = D.detect(a, D.KeywordDetector(), "content")
    return p.select("article_id", joined("prediction.frames").alias("frames"), *_scores("prediction.scores"))


@query
def ensemble_scores(spark, sf_dir):
    """Keyword rules and lexicon scores at 0.4 and 0.6."""
    a = articles(spark, sf_dir, "content").where("content is not null")
    p = D.detect(a, D.EnsembleDetector([D.KeywordDetector(), D.LexiconDetector()], [0.4, 0.6]), "content")
    return p.select("article_id", joined("prediction.frames").alias("frames"), *_scores("prediction.scores"))


@query
def threshold_frames(spark, sf_dir):
    """Frames of each stored prediction at two thresholds, and how many scores reach each confidence bin."""
    p = table(spark, sf_dir, "predictions").where("scores is not null").select("article_id", "detector", "predicted_at", F.array_sort(F.map_entries("scores")).alias("s")).distinct()
    p = p.withColumn("scores", F.map_from_entries("s"))
    return p.select("article_id", "detector", joined(D.frames_from(F.col("scores"))).alias("frames"), joined(D.frames_from(F.col("scores"), 0.7, strict=True)).alias("frames_70"), F.aggregate(F.map_values("scores"), F.lit(0), lambda n, s: n + F.coalesce(D.confidence_bin(s), F.lit(0))).cast("bigint").alias("bins"))


@query
def article_analysis(spark, sf_dir):
    """Windows of the raw articles, keyword rules, gathered per article."""
    a = A.FrameAnalyzer(D.KeywordDetector(), segment=True).analyze(articles(spark, sf_dir, "content").where("content is not null"), detailed=False)
    return a.select("article_id", "segments_analyzed", joined("frames_detected").alias("frames"), joined("demographics").alias("demographics"), *_scores("frame_scores"), F.coalesce(F.try_element_at("frame_counts.frames", F.lit("underrepresentation")), F.lit(0)).cast("bigint").alias("n_underrepresentation"))


@query
def article_analysis_preprocessed(spark, sf_dir):
    """Whole cleaned articles, keyword rules, with the groups of the cleaned text."""
    a = A.FrameAnalyzer(D.KeywordDetector(), preprocess=True).analyze(articles(spark, sf_dir, "content").where("content is not null"), detailed=False)
    return a.select("article_id", "segments_analyzed", joined("frames_detected").alias("frames"), joined("demographics").alias("demographics"), *_scores("frame_scores"))


@query
def analysis_summary(spark, sf_dir):
    s = A.FrameAnalyzer(D.KeywordDetector(), segment=True).summary(articles(spark, sf_dir, "content").where("content is not null"))
    return s.select("frame", "n_articles", F.round("mean_score", 6).alias("mean_score"))


# --- coding and agreement -------------------------------------------------------------------------------------------


def _facts(spark, sf_dir) -> DataFrame:
    """Coded cells as they were delivered, each once however often it came."""
    return table(spark, sf_dir, "coding_facts").select("article_id", "source", "frame_type", "demographic_group", "count", "coded_at").distinct()


@query
def frame_summary(spark, sf_dir):
    return V.frame_summary(_facts(spark, sf_dir))


@query
def frame_totals(spark, sf_dir):
    return V.totals(_facts(spark, sf_dir), "frame_type")


@query
def group_totals(spark, sf_dir):
    return V.totals(_facts(spark, sf_dir), "demographic_group")


@query
def frame_group_totals(spark, sf_dir):
    return V.totals(_facts(spark, sf_dir), "frame_type", "demographic_group")


@query
def annotation_counts(spark, sf_dir):
    """Annotations per frame and per group."""
    names = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in (("frame", "frame_type"), ("group", "demographic_group")))))
    return _facts(spark, sf_dir).select(names.alias("x")).groupBy("x.kind", "x.name").agg(F.count(F.lit(1)).alias("n"))


def _predictions(spark, sf_dir) -> DataFrame:
    """The latest run for each article."""
    p = table(spark, sf_dir, "predictions").where("article_id is not null")
    best = p.groupBy("article_id").agg(F.max(F.struct("predicted_at", "detector", F.array_sort(F.coalesce("frames", F.array().cast("array<string>"))).alias("frames"))).alias("p"))
    return best.select("article_id", "p.frames", "p.detector")


@query
def coding_merge(spark, sf_dir):
    a = articles(spark, sf_dir, "human_coding").select("article_id", F.array_sort(F.coalesce(C.coded_frames(F.col("human_coding")), F.array().cast("array<string>"))).alias("frames"))
    m = V.merge_with_predictions(a, _predictions(spark, sf_dir))
    return m.select("article_id", joined("frames_human").alias("frames_human"), joined("frames_predicted").alias("frames_predicted"), "detector")


def _flags(spark, sf_dir) -> DataFrame:
    a = articles(spark, sf_dir, "human_coding").select("article_id", C.coded_frames(F.col("human_coding")).alias("frames"))
    m = V.merge_with_predictions(a, _predictions(spark, sf_dir))
    return V.frame_flags(m, F.col("frames_human"), F.col("frames_predicted"))


@query
def agreement_metrics(spark, sf_dir):
    return V.agreement_metrics(_flags(spark, sf_dir)).select("metric", F.round("value", 6).alias("value"))


@query
def human_vs_ml_accuracy(spark, sf_dir):
    return V.match_accuracy(_flags(spark, sf_dir)).select(F.coalesce("frame", F.lit("overall")).alias("frame"), F.round("accuracy", 6).alias("accuracy"))


@query
def icc(spark, sf_dir):
    """Agreement of coding and prediction as two raters of each article and frame."""
    r = _flags(spark, sf_dir).select(F.col("human").cast("int").alias("a"), F.col("ml").cast("int").alias("b"))
    return V.icc(r, "a", "b").select("n", F.round("icc_ref", 6).alias("icc_ref"), F.round("icc_2_1", 6).alias("icc_2_1"))


@query
def frame_anova(spark, sf_dir):
    """Variance of the coded counts of each frame over the six groups within articles."""
    r = V.repeated_measures(_facts(spark, sf_dir), L.SUMMARY_GROUPS)
    return r.select("frame_type", "n", "df_conditions", "df_error", *(F.round(c, 4).alias(c) for c in ("ss_conditions", "ss_subjects", "ss_error", "f", "partial_eta2")))


@query
def tfidf_terms(spark, sf_dir):
    """Words by document frequency and idf: the thousand commonest, of which a limit is the point."""
    a = articles(spark, sf_dir, "content").where("content is not null")
    w = a.select("article_id", F.explode(F.array_distinct(X.tokens(F.col("content")))).alias("term")).where("term <> ''")
    n = a.count()
    df = w.groupBy("term").agg(F.count(F.lit(1)).alias("n_articles"))
    return df.orderBy(F.desc("n_articles"), "term").limit(1000).withColumn("idf", F.round(F.log((F.lit(n) + 1.0) / (F.col("n_articles") + 1.0)) + 1.0, 6))


@query
def tfidf_weights(spark, sf_dir):
    """The thousand commonest words and pairs of words, with their articles, idf and summed weights."""
    w = C.tfidf(articles(spark, sf_dir, "content"))
    return w.groupBy("term").agg(F.sum("tf").alias("tf"), F.max("n_articles").alias("n_articles"), F.round(F.max("idf"), 6).alias("idf"), F.round(F.sum("weight"), 4).alias("weight"))


@query
def source_frame_ranking(spark, sf_dir):
    """Frames by coded count within each source, with their share of the source."""
    f = _facts(spark, sf_dir).where("count is not null").withColumn("s", F.coalesce(F.lower(F.trim("source")), F.lit("")))
    t = f.groupBy("s", "frame_type").agg(F.sum("count").alias("total"))
    w = Window.partitionBy("s")
    return t.select(F.col("s").alias("source"), "frame_type", "total", F.rank().over(w.orderBy(F.desc("total"))).cast("bigint").alias("place"), F.round(F.col("total") / F.sum("total").over(w), 6).alias("share"))


@query
def frame_group_matrix(spark, sf_dir):
    """Windows of cleaned text by frame found and group mentioned, with the articles they are from."""
    return frame_groups(articles(spark, sf_dir, "content"))


def frame_groups(a: DataFrame) -> DataFrame:
    cleaned = a.where("content is not null").select("article_id", X.clean_text(F.col("content")).alias("content"))
    u = D.detect(A.units(cleaned), D.KeywordDetector())
    pairs = u.select("article_id", F.explode("prediction.frames").alias("frame"), "text").select("article_id", "frame", F.explode(F.map_keys(X.demographics(F.col("text")))).alias("grp"))
    return pairs.groupBy("frame", "grp").agg(F.count(F.lit(1)).alias("n_windows"), F.countDistinct("article_id").alias("n_articles"))
