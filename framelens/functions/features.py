"""Some seventy features of a text: lexicon counts, group mentions, style, numbers, and what stands near leadership terms.

Every lexicon term is counted by itself, so terms that overlap count twice. The words of a text are split once; single-word
terms are picked from them by one hashed set, and phrases by a few patterns whose alternatives cannot overlap. This gives the
same counts as one whole-word pattern a term, at a tenth of the scans.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens import lexicons as L
from framelens.functions import text as X


def all_terms() -> list[str]:
    lex = [t for cats in L.FRAME_LEXICONS.values() for terms in cats.values() for t in terms]
    demo = [t for groups in L.DEMOGRAPHIC_TERMS.values() for terms in groups.values() for t in terms]
    return list(dict.fromkeys([*lex, *demo]))


def phrase_groups(phrases: Iterable[str]) -> list[list[str]]:
    """Phrases dealt into as few lists as need be so that no two matches of a list can share a word."""
    out: list[list[str]] = []
    for p in phrases:
        w = re.findall(r"\w+", p)
        for group in out:
            # in a group, no phrase may end with the beginning of another (or of itself), nor hold another
            if not any(_may_overlap(w, re.findall(r"\w+", q)) for q in group):
                group.append(p)
                break
        else:
            out.append([p])
    return out


def _may_overlap(a: list[str], b: list[str]) -> bool:
    def meets(x: list[str], y: list[str]) -> bool:
        return any(x[i : i + len(y)] == y[: len(x) - i] for i in range(len(x)))

    return meets(a, b) or meets(b, a)


def found_terms(text: Column) -> Column:
    """array<string>: every occurrence of every lexicon term."""
    single = [t for t in all_terms() if re.fullmatch(r"\w+", t)]
    phrases = [t for t in all_terms() if not re.fullmatch(r"\w+", t)]
    low = F.lower(text)
    by_word = F.filter(X.tokens(text), lambda x: x.isin(single))
    by_phrase = [F.regexp_extract_all(low, F.lit(X.whole_words(g)), F.lit(0)) for g in phrase_groups(phrases)]
    return F.concat(by_word, *by_phrase)


def count_of(found: Column, terms: Iterable[str]) -> Column:
    terms = list(terms)
    return F.size(F.filter(found, lambda x: x.isin(terms))).cast("bigint")


def term_count(text: Column, terms: Iterable[str]) -> Column:
    """The same count by one whole-word pattern a term: what the fast path is tested against."""
    return sum((F.regexp_count(F.lower(text), F.lit(X.whole_words([t]))) for t in terms), F.lit(0)).cast("bigint")


def lexical_features(found: Column, n_words: Column) -> dict[str, Column]:
    """40 features: counts by frame and category, weighted totals, and each per word."""
    out: dict[str, Column] = {}
    for frame, categories in L.FRAME_LEXICONS.items():
        total = F.lit(0.0)
        for category, terms in categories.items():
            out[f"{frame}_{category}_count"] = (n := count_of(found, terms))
            total = total + n * L.CATEGORY_WEIGHTS.get(category, 1.0)
        out[f"{frame}_total_score"] = total
    return out | {f"{k}_normalized": F.when(n_words > 0, c / n_words).otherwise(F.lit(0.0)) for k, c in list(out.items())}


def demographic_features(found: Column) -> dict[str, Column]:
    """12 counts and two flags, which are 1 or null."""
    out = {f"demo_{kind}_{group}": count_of(found, terms) for kind, groups in L.DEMOGRAPHIC_TERMS.items() for group, terms in groups.items()}
    out["demo_intersect_black_women"] = F.when((out["demo_gender_women"] > 0) & (out["demo_race_black"] > 0), 1)
    out["demo_intersect_white_men"] = F.when((out["demo_gender_men"] > 0) & (out["demo_race_white"] > 0), 1)
    return out


def linguistic_features(text: Column) -> dict[str, Column]:
    """9 features. The average length is null where no piece between periods has a word."""
    out = {f"ling_{k}_count": F.regexp_count(text, F.lit("(?iU)" + p)).cast("bigint") for k, p in L.LINGUISTIC_PATTERNS.items()}
    pieces = F.split(text, r"\.", -1)
    lengths = F.filter(F.transform(pieces, X.word_count), lambda n: n > 0)
    total = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, b: a + b)
    out["ling_avg_sentence_length"] = F.when(F.size(lengths) > 0, total / F.size(lengths))
    out["ling_num_sentences"] = F.size(pieces).cast("bigint")
    for name, mark in (("questions", "?"), ("exclamations", "!")):
        out[f"ling_{name}"] = (F.char_length(text) - F.char_length(F.replace(text, F.lit(mark), F.lit("")))).cast("bigint")
    return out


def statistical_features(text: Column) -> dict[str, Column]:
    """Flags and values of percentages, numbers and comparisons; minimum and maximum are null without percentages."""
    values = F.transform(F.regexp_extract_all(text, F.lit("(?iU)" + L.PERCENTAGE), F.lit(1)), lambda x: x.cast("double"))
    numbers = F.regexp_count(text, F.lit("(?U)" + L.NUMBER)).cast("bigint")
    flag = lambda c: F.when(text.isNotNull(), c.cast("int"))
    return {
        "stats_has_percentages": flag(F.size(values) > 0),
        "stats_has_numbers": flag(numbers > 0),
        "stats_has_comparisons": flag(text.rlike("(?iU)" + L.COMPARISON)),
        "stats_percentage_values": values,
        "stats_min_percentage": F.array_min(values),
        "stats_max_percentage": F.array_max(values),
        "stats_count_numbers": numbers,
    }


def context_features(text: Column, size: int = 50) -> dict[str, Column]:
    """Number of position terms, and per frame how many of its terms are substrings of the contexts around them (null
    without any position term). A term that two categories have counts for each."""
    contexts = X.term_contexts(text, L.POSITION_TERMS, size)
    return _near(contexts)


def _near(contexts: Column) -> dict[str, Column]:
    joined = F.lower(F.array_join(F.transform(contexts, lambda c: c["context"]), " "))
    out = {"context_leadership_mentions": F.size(contexts).cast("bigint")}
    for frame, categories in L.FRAME_LEXICONS.items():
        n = sum((joined.contains(t).cast("int") for terms in categories.values() for t in terms), F.lit(0))
        out[f"context_{frame}_near_leadership"] = F.when(F.size(contexts) > 0, n.cast("bigint"))
    return out


def with_features(df: DataFrame, text: str = "text", kinds: Iterable[str] = ("lexical", "demographic", "linguistic", "statistical", "context", "size"), keep: Iterable[str] | None = None) -> DataFrame:
    """df with a column a feature (``keep``: these columns of df only).

    The expensive parts (words found, contexts) are columns of their own first, so that they are computed once a row.
    A kept column with the name of a feature gives way to it.
    """
    kinds, keep = set(kinds), [c for c in (df.columns if keep is None else keep) if c not in ("_found", "_words", "_contexts")]
    c = F.col(text)
    parts = {}
    if kinds & {"lexical", "demographic"}:
        parts["_found"] = found_terms(c)
    if kinds & {"lexical", "size"}:
        parts["_words"] = X.word_count(c)
    if "context" in kinds:
        parts["_contexts"] = X.term_contexts(c, L.POSITION_TERMS, 50)
    staged = df.select(*{*keep, text}, *(v.alias(k) for k, v in parts.items()))
    out: dict[str, Column] = {}
    if "lexical" in kinds:
        out |= lexical_features(F.col("_found"), F.col("_words"))
    if "demographic" in kinds:
        out |= demographic_features(F.col("_found"))
    if "linguistic" in kinds:
        out |= linguistic_features(c)
    if "statistical" in kinds:
        out |= statistical_features(c)
    if "context" in kinds:
        out |= _near(F.col("_contexts"))
    if "size" in kinds:
        out |= {"text_length": F.char_length(c).cast("bigint"), "word_count": F.col("_words")}
    return staged.select(*(c for c in keep if c not in out), *(v.alias(k) for k, v in out.items()))


def numeric_features() -> list[str]:
    """Names of the features that make up a vector, in their fixed order (the list of percentages isn't one number)."""
    c = F.lit("")
    names = [*lexical_features(F.array(), F.lit(0)), *demographic_features(F.array()), *linguistic_features(c), *statistical_features(c), *_near(F.array(F.struct(F.lit("").alias("context")))), "text_length", "word_count"]
    return [n for n in names if n != "stats_percentage_values"]


def feature_vectors(segments: DataFrame, text: str = "text", fallback: str = "content", labels: str | None = None) -> DataFrame:
    """segments with ``features`` (a vector; null numbers are 0) and, from an array of frames, ``label_vector`` of 0 and 1.

    The text is ``text``, else ``fallback``, else empty.
    """
    from pyspark.ml.feature import VectorAssembler

    sources = [F.col(c) for c in (text, fallback) if c in segments.columns]
    named = segments.withColumn("_text", F.coalesce(*sources, F.lit("")))
    names = numeric_features()
    full = with_features(named, "_text", keep=segments.columns).fillna(0, subset=[n for n in names])
    out = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(full.drop("features"))
    cols = [F.col(c) for c in (*(c for c in segments.columns if c != "features"), "features")]
    return out.select(*cols, multi_hot(F.col(labels)).alias("label_vector")) if labels else out.select(*cols)


def multi_hot(labels: Column) -> Column:
    """array<int> of 0 and 1 in the fixed order of the frames; null labels give zeros."""
    known = F.coalesce(labels, F.array().cast("array<string>"))
    return F.array(*(F.coalesce(F.array_contains(known, f), F.lit(False)).cast("int") for f in L.FRAMES))
