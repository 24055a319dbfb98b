"""Windows of sentences, quotations, and pieces around keywords."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelens import lexicons as L
from framelens.functions import text as X


def sliding_windows(sents: Column, window: int = 3, overlap: int = 1) -> Column:
    """array<struct<text, sentences, start_idx, end_idx, window_id>>.

    Up to ``window`` sentences make one window (none: an empty one that ends at -1). Otherwise windows start every
    window - overlap sentences, and a shorter last one takes what is left, with the overlap.
    """
    if not 0 <= overlap < window:
        raise ValueError("overlap must be at least 0 and less than the window")
    n, step = F.size(sents), window - overlap

    def one(start: Column, end: Column, no: Column) -> Column:
        part = F.slice(sents, start + 1, F.greatest(end - start + 1, F.lit(0)))
        return F.struct(F.array_join(part, " ").alias("text"), part.alias("sentences"), start.cast("int").alias("start_idx"), end.cast("int").alias("end_idx"), no.cast("int").alias("window_id"))

    starts = F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)), F.lit(step))
    full = F.transform(starts, lambda s, i: one(s, s + window - 1, i))
    last_end = (F.size(starts) - 1) * step + window - 1
    tail = F.when(last_end < n - 1, F.array(one(last_end + 1 - overlap, n - 1, F.size(starts))))
    whole = F.array(one(F.lit(0), n - 1, F.lit(0)))
    return F.when(sents.isNull(), None).when(n <= window, whole).otherwise(F.when(last_end < n - 1, F.concat(full, tail)).otherwise(full))


def quotes(text: Column, strict: bool = False) -> Column:
    """array<struct<text, attribution, full_match, pattern_id>>: straight-quoted speech in three passes, one after another,
    so that a quotation may come twice. strict takes the second pattern's parts in the order they stand, speaker as text."""

    empty = F.array().cast("array<struct<text:string,attribution:string,full_match:string,pattern_id:int>>")
    verbs = F.lower(text).rlike("said|says|according to|stated")
    beside = (r'(?iU)"\s*,?\s*(?:said|says|according to)\s', r'(?iU)\s(?:said|says|stated)\s*,?\s*"')

    def of(i: int, said: int, speaker: int | None) -> Column:
        p = "(?iU)" + L.QUOTE_PATTERNS[i]

        # the parts are taken from each match, which is short, not by a pass over the text for each of them
        def speech(m: Column) -> Column:
            who = X.strip(F.regexp_extract(m, p, speaker)) if speaker else F.lit(None).cast("string")
            return F.struct(X.strip(F.regexp_extract(m, p, said)).alias("text"), who.alias("attribution"), m.alias("full_match"), F.lit(i + 1).alias("pattern_id"))

        # the patterns are slow on long texts, and match nothing without quotation marks and, but for the last, a verb beside one
        possible = text.contains('"') & verbs & text.rlike(beside[i]) if speaker else text.contains('"')
        return F.when(possible, F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), speech)).otherwise(F.when(text.isNotNull(), empty))

    return F.concat(of(0, 1, 2), of(1, 1, 2) if strict else of(1, 2, 1), of(2, 1, None))


def keyword_segments(text: Column, keywords: Iterable[str] = L.SEGMENT_KEYWORDS, size: int = 100) -> Column:
    """array<struct<text, keyword, keyword_position, start, end, segment_id>>: pieces of ``size`` characters around each
    whole-word match, snapped to the sentence where a period lies inside the piece."""
    low, n = F.lower(text), F.char_length(text)

    def of(t: Column) -> Column:
        def piece(m: Column) -> Column:
            at, end = m["start"], m["start"] + F.char_length(m["text"])
            left = F.substring(text, F.greatest(F.lit(0), at - size) + 1, F.least(at, F.lit(size)))
            right = F.substring(text, end + 1, F.least(n - end, F.lit(size)))
            after = F.char_length(F.substring_index(left, ".", -1))
            start = F.when(left.contains("."), at - after).otherwise(F.greatest(F.lit(0), at - size))
            stop = F.when(right.contains("."), end + F.locate(".", right)).otherwise(F.least(n, end + size))
            return F.struct(X.strip(F.substring(text, start + 1, stop - start)).alias("text"), t["term"].alias("keyword"), (at - start).alias("keyword_position"), start.alias("start"), stop.alias("end"))

        return F.transform(X.matches_at(low, t["pattern"]), piece)

    flat = F.flatten(F.transform(X.present(low, keywords), of))
    return F.transform(flat, lambda s, i: F.struct(s["text"].alias("text"), s["keyword"].alias("keyword"), s["keyword_position"].alias("keyword_position"), s["start"].alias("start"), s["end"].alias("end"), i.alias("segment_id")))


def average_words(sents: Column) -> Column:
    """Mean number of words of the sentences; 0 without any."""
    total = F.aggregate(F.transform(sents, X.word_count), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return F.when(F.size(sents) > 0, total / F.size(sents)).otherwise(F.when(sents.isNotNull(), F.lit(0.0)))
