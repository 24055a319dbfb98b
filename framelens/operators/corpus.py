"""Articles as a table: latest rows, derived columns, coding facts, validation, splits and batches.

Defined results: null coding gives no fact; articles without content have null lengths; ties in an order are broken by the key.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from framelens import lexicons as L
from framelens.functions import text as X
from framelens.session import cut, small


#: Rows of a file whose losers are one row of what is sent to all, and how much of that there may be.
BLOCK_BITS, LOST_BLOCKS, LOST_ROWS = 12, 400_000, 8_000_000


def latest(articles: DataFrame, key: str = "article_id", order: str = "ingested_at") -> DataFrame:
    """One row an article, the latest; a null order comes before all others. Rows without a key are left out.

    Of a table read from files no text is moved: keys are counted by themselves, only repeated ones are settled, by order and
    then by the place of the row in the files, and the rows that lose are left out by that place. Their places are sent to all,
    block by block of a file, up to LOST_ROWS in LOST_BLOCKS (some 120 MB); only beyond that rows are joined by their place.
    Other tables are reduced by key; of rows as late, the one with the largest hash is taken.
    """
    rows = articles.where(F.col(key).isNotNull())
    try:
        placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return _reduced(rows, key, order)
    lost, n_blocks, n_rows = _lost(placed.select(key, order, "_file", "_row"), key, order)
    block = F.shiftright(F.col("_row"), BLOCK_BITS).alias("_block")
    if n_blocks <= LOST_BLOCKS and n_rows <= LOST_ROWS:
        kept = placed.select("*", block).join(F.broadcast(lost), ["_file", "_block"], "left")
        return kept.where(~F.coalesce(F.array_contains("_lost", F.col("_row")), F.lit(False))).select(*articles.columns)
    return placed.join(lost.select("_file", F.explode("_lost").alias("_row")), ["_file", "_row"], "left_anti").select(*articles.columns)


def _lost(placed: DataFrame, key: str, order: str) -> tuple[DataFrame, int, int]:
    """(_file, _block, _lost) of the rows that are not the latest of their key, how many blocks and how many rows.

    The table is kept for the application: the next query over the same files, unchanged, finds it.
    """
    context = placed.sparkSession.sparkContext
    known = context.__dict__.setdefault("_framelens_lost", {})
    stamp = _stamp(placed)
    if stamp is not None and stamp in known:
        return known[stamp]
    repeated = placed.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
    of_repeated = placed.join(small(cut(repeated, "repeated")), key, "left_semi")
    rank = F.struct(F.col(order).isNotNull(), order, "_file", "_row")
    best = of_repeated.groupBy(key).agg(F.max(rank).alias("_best"))
    losers = of_repeated.join(best, key).where(rank != F.col("_best")).select("_file", "_row")
    # one group is one block, of 2 ** BLOCK_BITS rows at most
    lost = cut(losers.groupBy("_file", F.shiftright(F.col("_row"), BLOCK_BITS).alias("_block")).agg(F.collect_set("_row").alias("_lost")), "lost")
    n = lost.agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.size("_lost")).alias("rows")).first()
    out = lost, n["blocks"], n["rows"] or 0
    if stamp is not None:
        known[stamp] = out
    return out


#: Tables of more files than this are settled anew by each query: asking for all their dates would take longer.
STAMPED_FILES = 1_000


def _stamp(df: DataFrame) -> tuple | None:
    """What tells whether a plan over files would give the same rows again: the plan, and name, length and date of each file."""
    files = df.inputFiles()
    if len(files) > STAMPED_FILES:
        return None
    hadoop, Path = df.sparkSession.sparkContext._jsc.hadoopConfiguration(), df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
    states = []
    for f in sorted(files):
        at = Path(df.sparkSession.sparkContext._jvm.java.net.URI(f))
        status = at.getFileSystem(hadoop).getFileStatus(at)
        states.append((f, status.getLen(), status.getModificationTime()))
    return df._jdf.queryExecution().optimizedPlan().canonicalized().toString(), tuple(states)


def _reduced(rows: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    by_hash = F.xxhash64(*(F.to_json(c) if isinstance(rows.schema[c].dataType, MapType | ArrayType | StructType) else F.col(c) for c in rest))
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(order).isNotNull(), order, by_hash)).alias("_best"))
    return best.select(*(F.col(key) if c == key else F.col(f"_best.`{c}`").alias(c) for c in rows.columns))


def load_articles(articles: DataFrame, source: str | None = None) -> DataFrame:
    """Articles, of one source if named, with content_length in characters and word_count."""
    df = articles if source is None else articles.where(F.col("source") == source)
    return df.withColumn("content_length", F.char_length("content").cast("bigint")).withColumn("word_count", X.word_count(F.col("content")))


def normalised_source(articles: DataFrame, mapping: DataFrame) -> DataFrame:
    """articles with ``canonical_source``: the name a known variant stands for, compared without case and outer blanks."""
    bare = lambda c: F.lower(F.trim(c))
    known = mapping.groupBy(bare(F.col("variant")).alias("_v")).agg(F.min("source").alias("_to"))
    return articles.join(known, bare(F.col("source")) == F.col("_v"), "left").withColumn("canonical_source", F.coalesce("_to", F.trim("source"))).drop("_v", "_to")


def parse_coding(coding: Column) -> Column:
    """The four frames only, each with a map (empty if absent)."""
    empty = F.create_map().cast("map<string,double>")
    return F.map_from_entries(F.array(*(F.struct(F.lit(f), F.coalesce(F.try_element_at(coding, F.lit(f)), empty)) for f in L.FRAMES)))


def coding_facts(articles: DataFrame, coding: str = "human_coding") -> DataFrame:
    """(article_id, source, frame_type, demographic_group, count): one row a coded cell, of any frame."""
    frames = articles.select("article_id", "source", F.explode(coding).alias("frame_type", "groups"))
    return frames.select("article_id", "source", "frame_type", F.explode("groups").alias("demographic_group", "count"))


def coded_frames(coding: Column) -> Column:
    """array of the frames that have any group."""
    return F.map_keys(F.map_filter(coding, lambda _, g: F.size(g) > 0))


def issues(articles: DataFrame, min_length: int = 50) -> DataFrame:
    """(article_id, issue): content too short or missing; no human coding."""
    short = F.coalesce(F.char_length("content") < min_length, F.lit(True))
    uncoded = F.coalesce(F.size("human_coding") <= 0, F.lit(True))
    found = F.array_compact(F.array(F.when(short, F.lit("content too short or missing")), F.when(uncoded, F.lit("no human coding"))))
    return articles.select("article_id", F.explode(found).alias("issue"))


def validation_summary(articles: DataFrame, min_length: int = 50) -> DataFrame:
    """One row: articles, range of dates, missing content, annotations, articles without coding, issues, validity."""
    cells = F.aggregate(F.map_values("human_coding"), F.lit(0), lambda n, g: n + F.greatest(F.size(g), F.lit(0)))
    short = F.coalesce(F.char_length("content") < min_length, F.lit(True)).cast("int")
    uncoded = F.coalesce(F.size("human_coding") <= 0, F.lit(True)).cast("int")
    out = articles.agg(
        F.count(F.lit(1)).alias("total_articles"),
        F.countDistinct("source").alias("n_sources"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count_if(F.col("content").isNull()).alias("missing_content"),
        F.coalesce(F.sum(cells), F.lit(0)).cast("bigint").alias("total_annotations"),
        F.coalesce(F.sum(uncoded), F.lit(0)).cast("bigint").alias("uncoded_articles"),
        F.coalesce(F.sum(short + uncoded), F.lit(0)).cast("bigint").alias("n_issues"),
    )
    missing = F.when(F.col("total_annotations") == 0, F.col("total_articles")).otherwise(F.lit(0)).cast("bigint")
    return out.withColumn("missing_coding", missing).withColumn("is_valid", F.col("n_issues") == 0)


def validation_counts(articles: DataFrame) -> DataFrame:
    """(kind, name, n): articles of each source, annotations of each frame and of each group, in one pass. Kinds are 'source',
    'frame' and 'group'; a null source is counted."""
    named = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"))
    cells = F.flatten(F.transform(F.map_entries("human_coding"), lambda f: F.flatten(F.transform(F.map_entries(f["value"]), lambda g: F.array(named("frame", f["key"]), named("group", g["key"]))))))
    # a frame without groups flattens to null
    filled = F.map_filter("human_coding", lambda _, g: g.isNotNull())
    each = F.concat(F.array(named("source", F.col("source"))), F.coalesce(cells, F.array().cast("array<struct<kind:string,name:string>>")))
    return articles.withColumn("human_coding", filled).select(F.explode(each).alias("x")).groupBy("x.kind", "x.name").agg(F.count(F.lit(1)).alias("n"))


#: Length of a content that is neither too short nor too long.
LEAST_LENGTH, MOST_LENGTH = 100, 50_000


def quality_issues(articles: DataFrame, shortest: int = LEAST_LENGTH, longest: int = MOST_LENGTH, expected: str = "en", least_share: float = 0.0) -> DataFrame:
    """(article_id, issue): 'too short', 'too long', 'encoding', 'language', 'duplicate'.

    encoding: a replacement character, or a control character other than tabs and line ends. language: known, and another than
    ``expected`` (with a score of least_share and more). duplicate: an article with a smaller id has the same cleaned text
    (found by its md5: no text is moved). Null contents are too short and nothing else.
    """
    from framelens.functions.language import language

    c = F.col("content")
    staged = articles.select("article_id", "content", language(c).alias("_l"), F.md5(X.clean_text(c)).alias("_h"))
    found = F.array_compact(
        F.array(
            F.when(F.coalesce(F.char_length(c) < shortest, F.lit(True)), F.lit("too short")),
            F.when(F.char_length(c) > longest, F.lit("too long")),
            F.when(c.rlike(r"[\x{FFFD}\x00-\x08\x0E-\x1F\x7F]"), F.lit("encoding")),
            F.when((F.col("_l.lang") != expected) & (F.col("_l.score") >= least_share), F.lit("language")),
        )
    )
    issues = cut(staged.select("article_id", "_h", found.alias("_found")), "issues")
    first = issues.where("_h is not null").groupBy("_h").agg(F.min("article_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    repeated = issues.join(first, "_h").where(F.col("article_id") != F.col("_first")).select("article_id", F.lit("duplicate").alias("issue"))
    return issues.select("article_id", F.explode("_found").alias("issue")).unionByName(repeated)


def without_duplicates(articles: DataFrame) -> DataFrame:
    """articles but for those whose cleaned text an article with a smaller id has."""
    repeated = quality_issues(articles).where("issue = 'duplicate'").select("article_id")
    return articles.join(small(cut(repeated, "duplicates")), "article_id", "left_anti")


def head(articles: DataFrame, n: int = 5, key: str = "article_id") -> DataFrame:
    """The first n articles by id: a limit is the point."""
    return articles.orderBy(key).limit(n)


def split_sizes(n: int, val: float = 0.2, test: float = 0.2, of_total: bool = False) -> tuple[int, int, int]:
    """Sizes of train, val and test; val is a part of what test leaves, unless of_total."""
    rest = int(n * (1 - test))
    train = int(rest - n * val) if of_total else int(rest * (1 - val))
    return train, rest - train, n - rest


#: Rows in a range of hashes, on average, that one task puts in order.
RANGE_ROWS = 50_000


def train_val_test(articles: DataFrame, key: str = "article_id", val: float = 0.2, test: float = 0.2, seed: int = 42, by: str | None = None) -> DataFrame:
    """articles with ``split``: exact sizes, in an order drawn by the md5 of key and seed; within each ``by`` if given.

    No task holds all rows, or all of a ``by``: the rank of a row is the number of rows in the ranges of the hash before its
    own, which are counted first, and its rank within its range. A null ``by`` is a group like others.
    """
    n_rows = articles.count()
    digits = max(1, math.ceil(math.log(max(n_rows, 1) / RANGE_ROWS + 1, 16)))
    group = [F.col(by).alias("_by")] if by is not None else [F.lit(0).alias("_by")]
    h = F.md5(F.concat_ws("_", F.col(key).cast("string"), F.lit(str(seed))))
    keyed = articles.select(*articles.columns, *group, h.alias("_h")).withColumn("_range", F.substring("_h", 1, digits))
    counts = keyed.groupBy("_by", "_range").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("_by")  # 16 ** digits rows a group at most
    before = counts.select(F.col("_by").alias("_by2"), F.col("_range").alias("_range2"), F.coalesce(F.sum("_c").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(w).alias("_n"))
    within = F.row_number().over(Window.partitionBy("_by", "_range").orderBy("_h", key))
    same = F.col("_by").eqNullSafe(F.col("_by2")) & (F.col("_range") == F.col("_range2"))
    ranked = keyed.withColumn("_k", within).join(before, same, "inner").withColumn("_rank", F.col("_before") + F.col("_k"))
    rest = F.floor(F.col("_n") * F.lit(1 - test))
    train = F.floor(rest * F.lit(1 - val))
    split = F.when(F.col("_rank") <= train, "train").when(F.col("_rank") <= rest, "val").otherwise("test")
    return ranked.select(*(F.col(c) for c in articles.columns if c != "split"), split.alias("split"))


def folds(articles: DataFrame, k: int = 5, key: str = "article_id", seed: int = 42) -> DataFrame:
    """articles with ``fold`` from 0 to k - 1 by the md5 of key and seed, for cross-validation."""
    h = F.md5(F.concat_ws("_", F.col(key).cast("string"), F.lit(str(seed))))
    return articles.withColumn("fold", (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % k).cast("int"))


def batches(df: DataFrame, size: int, order: str, within: str) -> DataFrame:
    """df with ``batch``: consecutive slices of ``size`` rows in the given order inside each ``within``, the last one shorter.

    Rows are put into ranges of the order first; a task ranks the rows of one range, and the ranges before are added. The
    ranges are written to the shared folder, since they must be the same for counting and for ranking.
    """
    ranged = cut(df.repartitionByRange(F.col(within), F.col(order)).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(F.col(within).alias("_w"), F.col("_p").alias("_q")).agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select("_w", "_q", F.coalesce(F.sum("_c").over(Window.partitionBy("_w").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(within, "_p").orderBy(order))
    ranked = ranged.withColumn("_k", rank).join(before, F.col(within).eqNullSafe(F.col("_w")) & (F.col("_p") == F.col("_q")))
    return ranked.select(*df.columns, F.floor((F.col("_before") + F.col("_k") - 1) / size).cast("bigint").alias("batch"))


def preprocess(articles: DataFrame) -> DataFrame:
    """The whole chain on cleaned text, in one narrow stage."""
    base = articles.withColumn("cleaned_content", X.clean_text(F.col("content"))).withColumnRenamed("content", "original_content")
    c = F.col("cleaned_content")
    staged = base.withColumn("sentences", X.sentences(c))
    coding = ["human_coding"] if "human_coding" in articles.columns else []
    return staged.select(
        "article_id", "source", "date", "title", "original_content", "cleaned_content", "sentences",
        X.paragraphs(c).alias("paragraphs"),
        X.leadership_contexts(c).alias("leadership_contexts"),
        X.demographics(c).alias("demographics_found"),
        X.statistics(c).alias("statistics"),
        X.frame_candidates(c).alias("frame_candidates"),
        X.word_count(c).alias("word_count"),
        F.size("sentences").cast("bigint").alias("sentence_count"),
        *coding,
    )


def ngrams(text: Column) -> Column:
    """Words of two characters and more, in lower case, and their pairs in order."""
    words = F.filter(X.tokens(text), lambda w: F.char_length(w) > 1)
    return X.bound(words, lambda w: F.concat(w, F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))))


def tfidf(articles: DataFrame, n_terms: int = 1000, text: str = "content") -> DataFrame:
    """(article_id, term, tf, n_articles, idf, weight): the n_terms commonest words and pairs of words (of equals the first by
    name), their counts in each article, and weights tf * idf of length 1 in each article; idf = ln((1 + n) / (1 + n_articles)) + 1.

    Only counts are moved: the terms are chosen by counts combined before the shuffle, and sent to all (n_terms rows).
    Null texts take no part.
    """
    grams = articles.where(F.col(text).isNotNull()).select("article_id", ngrams(F.col(text)).alias("_g"))
    n = articles.where(F.col(text).isNotNull()).count()
    totals = grams.select(F.explode("_g").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("_n"))
    chosen = cut(totals.orderBy(F.desc("_n"), "term").limit(n_terms).select("term"), "terms")
    tf = cut(grams.select("article_id", F.explode("_g").alias("term")).join(F.broadcast(chosen), "term", "left_semi").groupBy("article_id", "term").agg(F.count(F.lit(1)).alias("tf")), "tf")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("n_articles"))
    idf = df.withColumn("idf", F.log((F.lit(n) + 1.0) / (F.col("n_articles") + 1.0)) + 1.0)
    raw = tf.join(F.broadcast(idf), "term").withColumn("_w", F.col("tf") * F.col("idf"))
    norms = raw.groupBy("article_id").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return raw.join(norms, "article_id").select("article_id", "term", "tf", "n_articles", "idf", (F.col("_w") / F.col("_norm")).alias("weight"))


def training_examples(articles: DataFrame, text: str = "content") -> DataFrame:
    """(article_id, paragraph_no, text, demographics, labels): relevant paragraphs with the article's coded frames."""
    labels = coded_frames(F.col("human_coding")) if "human_coding" in articles.columns else F.lit(None).cast("array<string>")
    cells = articles.select("article_id", labels.alias("labels"), F.posexplode(X.paragraphs(F.col(text))).alias("paragraph_no", "text"))
    kept = cells.where(X.is_relevant(F.col("text")))
    return kept.select("article_id", "paragraph_no", "text", F.map_keys(X.demographics(F.col("text"))).alias("demographics"), "labels")


def exemplars(articles: DataFrame, text: str = "content") -> DataFrame:
    """(article_id, frame_type, demographic_group, exemplars): sentences that have a leadership term, a group and an indicator
    of the frame as whole words, by the coding rules."""
    sents = articles.select("article_id", F.explode(X.sentences(F.col(text))).alias("s"))
    low = F.lower(F.col("s"))
    in_context = sents.where(low.rlike(X.whole_words(L.LEADERSHIP_TERMS)))
    frames = F.array_compact(F.array(*(F.when(low.rlike(X.whole_words(terms)), F.lit(f)) for f, terms in L.FRAME_INDICATORS.items())))
    pairs = in_context.select("article_id", F.explode(frames).alias("frame_type"), "s").select("article_id", "frame_type", F.explode(F.map_keys(X.demographics(F.col("s")))).alias("demographic_group"))
    return pairs.groupBy("article_id", "frame_type", "demographic_group").agg(F.count(F.lit(1)).alias("exemplars"))
