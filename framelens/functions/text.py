"""Cleaning, words, sentences, paragraphs, and where terms stand in a text.

Null texts give null (arrays: null); empty texts give empty results. Lengths and offsets count code points. Patterns are
Unicode-aware. Where lowering a text changes its length, offsets are those in the lowered text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelens import lexicons as L

MIN_SENTENCE, MIN_PARAGRAPH = 10, 20


def quote(term: str) -> str:
    """A literal term inside a Java pattern."""
    return re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", term)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column, straight_quotes: bool = False) -> Column:
    """Without web addresses, every run of whitespace one blank, trimmed. straight_quotes also straightens curly quotes."""
    out = F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)https?://\S+", ""), r"(?U)\s+", " "))
    return F.translate(out, "“”‘’", "\"\"''") if straight_quotes else out


def words(c: Column) -> Column:
    """Pieces between whitespace."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("bigint")


def tokens(c: Column) -> Column:
    """Lower-case words of letters, digits and underscores, split once for all lexicon counts."""
    return F.split(F.lower(c), r"(?U)\W+")


def whole_words(terms: Iterable[str]) -> str:
    """Pattern of any of the terms as a whole word.

    A single term stands first in its pattern, with the look behind it after it: the engine then searches for the literal
    and tests for a word's beginning only where it is found, not at every character.
    """
    quoted = list(map(quote, terms))
    if len(quoted) == 1:
        return rf"(?U){quoted[0]}(?<!\w{quoted[0]})(?!\w)"
    return r"(?U)\b(?:" + "|".join(quoted) + r")\b"


def sentences(c: Column, longer_than: int = MIN_SENTENCE) -> Column:
    """Cut after . ! ? before whitespace; pieces of more than ``longer_than`` characters, trimmed."""
    mark = "\u0001"
    pieces = F.split(F.regexp_replace(c, r"(?U)([.!?])\s+", "$1" + mark), mark)
    return F.filter(F.transform(pieces, strip), lambda x: F.char_length(x) > longer_than)


def paragraphs(c: Column, longer_than: int = MIN_PARAGRAPH) -> Column:
    """Cut at blank lines; pieces of more than ``longer_than`` characters, trimmed."""
    return F.filter(F.transform(F.split(c, r"(?U)\n\s*\n"), strip), lambda x: F.char_length(x) > longer_than)


def matches_at(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, text>> of all matches with their 0-based offsets, in order.

    The pattern must not match the empty string, nor look around across its own ends but for word boundaries. The pieces
    between matches and the matches themselves are added up; no function of Spark gives offsets directly.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("found"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.char_length(pair["piece"])
        return F.struct((begin + F.char_length(pair["hit"])).alias("at"), F.concat(acc["found"], F.array(F.struct(begin.alias("start"), pair["hit"].alias("text")))).alias("found"))

    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda p, h: F.struct(p.alias("piece"), h.alias("hit")))
    return F.when(F.size(hits) > 0, F.aggregate(pairs, start, step, lambda acc: acc["found"])).otherwise(F.when(text.isNotNull(), F.array().cast("array<struct<start:int,text:string>>")))


def around(text: Column, start: Column, end: Column, size: int) -> Column:
    """text[max(0, start - size) : end + size]"""
    low = F.greatest(F.lit(0), start - size)
    return F.substring(text, low + 1, end + size - low)


def term_contexts(text: Column, terms: Iterable[str], size: int) -> Column:
    """array<struct<term, start, end, context>>: each whole-word match of each term, terms in the order given.

    start and end are those of the context, which reaches ``size`` characters to both sides.
    """
    low, n = F.lower(text), F.char_length(text)

    def of(t: Column) -> Column:
        def context(m: Column) -> Column:
            end = m["start"] + F.char_length(m["text"])
            return F.struct(t["term"].alias("term"), F.greatest(F.lit(0), m["start"] - size).alias("start"), F.least(n, end + size).alias("end"), around(text, m["start"], end, size).alias("context"))

        return F.transform(matches_at(low, t["pattern"]), context)

    return F.flatten(F.transform(present(low, terms), of))


def present(low: Column, terms: Iterable[str]) -> Column:
    """array<struct<term, pattern>> of the terms that are in a text at all, in the order given.

    The terms are data, so that the plan stays as small for a hundred terms as for one. A substring test is far cheaper than
    a pattern, and fails for most terms.
    """
    known = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(whole_words([t.lower()])).alias("pattern")) for t in terms))
    return F.when(low.isNotNull(), F.filter(known, lambda t: low.contains(F.lower(t["term"]))))


def leadership_contexts(text: Column, size: int = 100) -> Column:
    return term_contexts(text, L.LEADERSHIP_TERMS, size)


def is_relevant(text: Column) -> Column:
    """Holds a leadership term anywhere, also inside a word."""
    low = F.lower(text)
    out = F.lit(False)
    for t in L.LEADERSHIP_TERMS:
        out = out | low.contains(t)
    return out


def demographics(text: Column) -> Column:
    """map<group, array of matches>: the mentions of each group in order, and the groups that follow from two together."""
    low = F.lower(text)
    found = F.array(*(F.regexp_extract_all(low, F.lit(rf"(?U)\b({p})\b"), F.lit(1)) for p in L.GROUP_PATTERNS.values()))

    def groups(hits: Column) -> Column:
        own = {g: F.get(hits, F.lit(i)) for i, g in enumerate(L.GROUP_PATTERNS)}
        has = {g: F.size(h) > 0 for g, h in own.items()}
        of_color = has["black"] | has["hispanic"] | has["asian"] | has["poc"]
        derived = {"women_of_color": has["women"] & of_color, "white_men": has["men"] & has["white"], "white_women": has["women"] & has["white"], "men_of_color": has["men"] & of_color}
        entries = [*((F.lit(g), h) for g, h in own.items()), *((F.lit(g), F.when(c, F.array(F.lit(g.replace("_", " ")))).otherwise(F.array().cast("array<string>"))) for g, c in derived.items())]
        return F.map_filter(F.create_map(*(x for e in entries for x in e)), lambda _, v: F.size(v) > 0)

    return F.when(text.isNotNull(), bound(found, groups))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def statistics(text: Column, size: int = 50) -> Column:
    """array<struct<type, value, direction, context>>: all percentages, then all comparisons ('3 times more')."""

    def of(kind: str, pattern: str, direction: bool) -> Column:
        p = "(?iU)" + pattern
        found = matches_at(text, p)
        return F.transform(
            found,
            lambda m: F.struct(
                F.lit(kind).alias("type"),
                F.regexp_extract(m["text"], p, 1).alias("value"),
                (F.regexp_extract(m["text"], p, 2) if direction else F.lit(None).cast("string")).alias("direction"),
                around(text, m["start"], m["start"] + F.char_length(m["text"]), size).alias("context"),
            ),
        )

    return F.concat(of("percentage", L.PERCENTAGE, False), of("comparison", L.COMPARISON, True))


def frame_candidates(text: Column, size: int = 50) -> Column:
    """map<frame, array of contexts>: for each indicator that is in the text, the contexts of its whole-word matches; frames
    without any are left out. See ``context_windows``."""
    low = F.lower(text)
    entries = (x for f, terms in L.FRAME_INDICATORS.items() for x in (F.lit(f), F.flatten(F.transform(present(low, terms), lambda t: context_windows(low, t, size)))))
    return F.map_filter(F.create_map(*entries), lambda _, v: F.size(v) > 0)


def context_windows(low: Column, term: str | Column, size: int) -> Column:
    """array<string>: what the pattern .{0,size}\\bterm\\b.{0,size} matches in each line, one after another without overlap.

    The pattern itself tries ``size`` prefixes at every position. Here the places of the term are found first, and one pass
    over them gives the same windows: a window begins ``size`` before the first place that is not covered yet, holds the last
    place that ``size`` characters of prefix can reach, and ends ``size`` after it. ``term`` is a literal, or a struct of term
    and pattern.
    """
    if isinstance(term, str):
        return F.flatten(F.transform(present(low, [term]), lambda t: context_windows(low, t, size)))
    width = F.char_length(term["term"])

    def of_line(line: Column) -> Column:
        n = F.char_length(line)
        start = F.array().cast("array<struct<s:int,p:int,e:int>>")

        def step(done: Column, m: Column) -> Column:
            at, end = m["start"], F.least(n, m["start"] + width + size)
            last = F.get(done, F.size(done) - 1)
            new = F.array(F.struct(F.greatest(at - size, F.coalesce(last["e"], F.lit(0)), F.lit(0)).alias("s"), at.alias("p"), end.alias("e")))
            longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["s"].alias("s"), at.alias("p"), end.alias("e"))))
            return F.when((F.size(done) > 0) & (at - last["s"] <= size), longer).when((F.size(done) == 0) | (at >= last["e"]), F.concat(done, new)).otherwise(done)

        spans = F.aggregate(matches_at(line, term["pattern"]), start, step)
        return F.transform(spans, lambda x: F.substring(line, x["s"] + 1, x["e"] - x["s"]))

    lines = F.filter(F.split(low, "\n"), lambda x: x.contains(term["term"]))
    return F.flatten(F.transform(lines, of_line))


def simple_demographics(text: Column) -> Column:
    """The short list of groups of the demonstration, with its two derived groups."""
    low = F.lower(text)
    found = F.array(*(low.rlike(rf"(?U)\b(?:{p})\b") for p in L.SIMPLE_GROUPS.values()))

    def groups(flags: Column) -> Column:
        has = {g: F.get(flags, F.lit(i)) for i, g in enumerate(L.SIMPLE_GROUPS)}
        has |= {"women_of_color": has["women"] & (has["black"] | has["poc"]), "white_men": has["men"] & has["white"]}
        return F.array_compact(F.array(*(F.when(c, F.lit(g)) for g, c in has.items())))

    return F.when(text.isNotNull(), bound(found, groups))


def mentioned_people(text: Column) -> Column:
    """'women' and 'men' by substrings, as the analyser falls back to ('management' mentions men)."""
    low = F.lower(text)
    women, men = low.contains("women") | low.contains("woman"), low.contains("men") | low.contains("man")
    return F.array_compact(F.array(F.when(women, F.lit("women")), F.when(men, F.lit("men"))))
