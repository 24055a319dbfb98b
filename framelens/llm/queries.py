"""The pN_ queries of this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window

from pyspark.sql import functions as F

from framelens.llm import crosssplit, encoding, grouped_split, mixing, neardup, packing, pieces, residue, sentences, tokens
from framelens.operators import corpus
from framelens.session import cut, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of related articles of each article, by source and authors."""
    return grouped_split.groups(table(spark, sf_dir, "sample_articles"), table(spark, sf_dir, "source_mapping"))


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article's split; related articles are never parted."""
    return grouped_split.splits(p2_found(spark, sf_dir))


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles, groups and share of each split."""
    s = p2_splits(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n_articles"), F.countDistinct("group_id").alias("n_groups"))
    return s.withColumn("share", F.round(F.col("n_articles") / F.sum("n_articles").over(Window.partitionBy(F.lit(1))), 6))


def p2_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of the splits: every article once, no group parted, each share within a thousandth."""
    s = cut(p2_splits(spark, sf_dir), "splits")
    by = s.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("split").alias("parts"))
    whole = by.agg(F.sum("n").alias("n_articles"), F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("parts") > 1).alias("n_parted"))
    sizes = s.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    far = sizes.join(F.broadcast(whole.select("n_articles"))).agg(F.count_if(F.abs(F.col("n") / F.col("n_articles") - F.element_at(F.create_map(*(F.lit(x) for kv in grouped_split.SHARES.items() for x in kv)), F.col("split"))) > 0.001).alias("n_far_off"))
    return whole.join(F.broadcast(far))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and contents with any garbled text."""
    return encoding.found(table(spark, sf_dir, "sample_articles"))


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled titles and contents as they were written, as far as it can be known."""
    return encoding.restored(table(spark, sf_dir, "sample_articles"))


def p3_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fields were found by a twin, by a learned mapping and by codec alone, and of which transformation."""
    return encoding.ways(table(spark, sf_dir, "sample_articles"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units of every article whose content isn't garbled."""
    return sentences.split_sentences(table(spark, sf_dir, "sample_articles")).drop("unit_no")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an evaluation and a training article, the smaller key first."""
    found = crosssplit.overlaps(table(spark, sf_dir, "sample_articles"), table(spark, sf_dir, "article_splits"), least=0.6)
    return found.select(F.least("eval_id", "train_id").alias("article_id_a"), F.greatest("eval_id", "train_id").alias("article_id_b")).distinct()


def p5_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of equal texts that each article of a split is in, on which side of the comparison, and how large it is."""
    members = crosssplit.links(table(spark, sf_dir, "sample_articles"), table(spark, sf_dir, "article_splits"), least=0.6)[1]
    sizes = members.groupBy("part", "rep").agg(F.countDistinct("key").alias("n_articles"))
    return members.join(sizes, ["part", "rep"]).select(F.col("key").alias("article_id"), "split", "part", F.col("rep").alias("class_id"), "n_articles")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of the evaluation splits that overlap the training split, per split and source."""
    articles = corpus.normalised_source(table(spark, sf_dir, "sample_articles"), table(spark, sf_dir, "source_mapping"))
    return crosssplit.report(articles.withColumn("source", F.lower("canonical_source")), table(spark, sf_dir, "article_splits"), least=0.6)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles above the limit: cut by force somewhere, or at natural boundaries only."""
    cuts = pieces.pieces(table(spark, sf_dir, "sample_articles"))
    return cuts.groupBy("article_id").agg(F.when(F.bool_or("forced"), "forced").otherwise("natural").alias("cut"))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered pieces of at most 3,000 characters, each starting with up to the last 200 characters of the one before."""
    return pieces.pieces(table(spark, sf_dir, "sample_articles"))


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of the pieces of each article: they cover it without a gap, none is over the limit, the overlap is within its."""
    p = p6_pieces(spark, sf_dir)
    size = F.col("char_end") - F.col("char_start")
    by = p.groupBy("article_id").agg(F.max("char_end").alias("n_chars"), F.sum(F.col("char_end") - F.col("new_start")).alias("n_new"), F.count(F.lit(1)).alias("n"), (F.max("piece_no") + 1).alias("numbered"), F.max(size).alias("longest"), F.max(F.col("new_start") - F.col("char_start")).alias("overlap"), F.min(F.col("new_start") - F.col("char_start")).alias("gap"))
    good = (F.col("n_new") == F.col("n_chars")) & (F.col("n") == F.col("numbered")) & (F.col("longest") <= 3000) & (F.col("overlap") <= 200) & (F.col("gap") >= 0)
    return by.select("article_id", "n_chars", good.cast("int").alias("good"))


def p6_token_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents of more than 512 tokens in pieces of at most 512, with up to 32 tokens of the piece before."""
    return pieces.pieces(table(spark, sf_dir, "documents"), "doc_id", "text", 512, 32, "fetched_at", tokens.vocabulary_path())


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of near copies; copies of one text pair by pair, in a class of 64 and more as links to the smallest (p7_groups
    has the size of each class)."""
    return neardup.pairs(table(spark, sf_dir, "sample_articles"), threshold=0.6)


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of equal texts and the group of near copies of each article, with its number of copies and links."""
    return neardup.groups(table(spark, sf_dir, "sample_articles"), threshold=0.6)


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles without near copies: of each group the smallest key stays, and all articles too short to compare."""
    others = p7_groups(spark, sf_dir).where("article_id <> group_id").select("article_id")
    return table(spark, sf_dir, "sample_articles").select("article_id").where("article_id is not null").distinct().join(others, "article_id", "left_anti")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of at most 2,048 tokens: which text, or which part of an oversized one, is in which."""
    return packing.containers(table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill(p8_containers(spark, sf_dir))


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of the containers: every text whole, none over the capacity, no text cut that needn't be."""
    c = p8_containers(spark, sf_dir)
    texts = c.groupBy("doc_id").agg(F.sum("size").alias("n"), F.max(F.col("start") + F.col("size")).alias("last"), F.count(F.lit(1)).alias("parts"), F.countDistinct("part").alias("different"))
    whole = texts.agg(F.count(F.lit(1)).alias("n_texts"), F.count_if((F.col("n") != F.col("last")) | (F.col("parts") != F.col("different")) | (F.col("parts") != F.ceil(F.col("n") / packing.CAPACITY))).alias("n_wrong"))
    over = c.groupBy("container").agg(F.sum("size").alias("n")).agg(F.count_if(F.col("n") > packing.CAPACITY).alias("n_over"))
    return whole.join(F.broadcast(over))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the mix and how often each is used."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of the mix: no text over its source's repeats, and each source that has text at its share among those that
    have, as near as its largest text allows."""
    s = p9_shares(spark, sf_dir)
    largest = p9_mix(spark, sf_dir).agg(F.coalesce(F.max("n_tokens"), F.lit(0)).alias("largest"))
    whole = s.agg(F.sum(F.when(F.col("available") > 0, F.col("target_share"))).alias("able"), F.sum("tokens").alias("total"))
    far = (F.col("available") > 0) & (F.abs(F.col("tokens") - F.col("target_share") / F.col("able") * F.col("total")) > F.col("largest"))
    return s.join(F.broadcast(whole)).join(F.broadcast(largest)).select("source", "target_share", "max_repeats", (F.col("available") > 0).cast("int").alias("has_text"), (F.col("most_uses") <= F.col("max_repeats")).cast("int").alias("within_repeats"), (~far).cast("int").alias("at_share"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are template residue, filler, an error page or a demand for scripts in place of an article."""
    return residue.found(table(spark, sf_dir, "documents"))


def p10_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without those of p10_found."""
    return residue.without(table(spark, sf_dir, "documents"))


def p10_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and furniture that recur over sources: normalised lines with their class, texts and sources."""
    groups = residue.messages(residue.lines_of(table(spark, sf_dir, "documents")))
    return groups.where("kind <> 'article' and kind <> 'headline' and n_sources > 1").select("line", "kind", "n_texts", "n_sources")


def queries() -> dict:
    return {n: f for n, f in globals().items() if n[0] == "p" and n[1].isdigit()}
