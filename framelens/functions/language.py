"""Language of a text by its script and its function words, and wordings of the frames. Native expressions only.

Null and empty texts have no language (null) and no wording.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelens import lexicons as L
from framelens.functions import text as X

def language(text: Column) -> Column:
    """struct<lang, score>: the language with the largest score (the first by name of several), null without letters or score.

    A score is the share of a script's letters, or for languages in Latin letters the share of their function words, times the
    share of other letters. Japanese has kana; Han letters count for it only beside kana, else for Chinese. Letters and words
    are counted once each.
    """
    letters = F.array(*(F.regexp_count(text, F.lit(p)).cast("double") for p in (r"[\p{L}\p{M}]", *L.SCRIPTS.values())))
    words = X.bound(X.tokens(text), lambda w: F.array(F.size(F.filter(w, lambda x: x != "")).cast("double"), *(F.size(_among(w, known)).cast("double") for known in L.FUNCTION_WORDS.values())))
    return X.bound(F.struct(letters.alias("letters"), words.alias("words")), _best)


def _among(words: Column, known: tuple[str, ...]) -> Column:
    return F.filter(words, lambda w: w.isin(*known))


def _best(counted: Column) -> Column:
    n = F.get(counted["letters"], F.lit(0))
    of = {k: F.get(counted["letters"], F.lit(i + 1)) for i, k in enumerate(L.SCRIPTS)}
    share = {k: F.least(F.lit(1.0), v / n) for k, v in of.items()}  # digits may be of a script
    latin = F.greatest(F.lit(0.0), F.lit(1.0) - sum(share.values(), F.lit(0.0)))
    share["ja"], share["zh"] = F.when(of["ja"] > 0, F.least(F.lit(1.0), share["ja"] + share["zh"])).otherwise(F.lit(0.0)), F.when(of["ja"] > 0, F.lit(0.0)).otherwise(share["zh"])
    all_words = F.greatest(F.get(counted["words"], F.lit(0)), F.lit(1.0))
    for i, lang in enumerate(L.FUNCTION_WORDS):
        share[lang] = latin * F.get(counted["words"], F.lit(i + 1)) / all_words
    best = F.array_min(F.array(*(F.struct((-v).alias("s"), F.lit(k).alias("lang")) for k, v in share.items())))
    return F.when(n > 0, X.bound(best, lambda b: F.when(b["s"] < 0, F.struct(b["lang"].alias("lang"), (-b["s"]).alias("score")))))


_PERCENT = r"\d+(?:\.\d+)?\s*(?:%|percent)"


def template_terms() -> dict[str, str]:
    """What a place in brackets stands for: patterns made of the lexicons."""
    any_of = lambda terms: "(?:" + "|".join(sorted(map(re.escape, terms), key=lambda t: (-len(t), t))) + ")"
    position = any_of(L.LEADERSHIP_TERMS) + "s?(?: (?:roles?|positions?|jobs?))?"
    # a group may be named by two words, such as black women
    group = "(?:" + "|".join(L.GROUP_PATTERNS.values()) + ")"
    return {
        "demographic": f"{group}(?: (?:of color|{group}))?",
        "leadership position": position,
        "leadership roles": position,
        "leadership positions": position,
        "position": position,
        "sector/position": r"(?:the )?\w+",
        "discrimination type": any_of((*L.FRAME_LEXICONS["obstacles"]["discrimination"], "sexism", "racism")),
        "obstacle metaphor": r"(?:an? |the )?(?:\w+ )?" + any_of(L.FRAME_LEXICONS["obstacles"]["structural"]),
        "milestone": r"(?:an? |the )?(?:\w+ )?" + any_of(L.FRAME_LEXICONS["successes"]["milestone"]),
    }


def template_pattern(template: str) -> str:
    """The pattern of a wording, in lower case, with any whitespace between its words."""
    known = template_terms()
    parts = re.split(r"(\[[^\]]+\]|X%)", template)
    out = "".join(known[p[1:-1]] if p[:1] == "[" else _PERCENT if p == "X%" else re.escape(p.lower()).replace("\\ ", r"\s+") for p in parts)
    return rf"(?:^|[^\w]){out}(?:[^\w]|$)"


def frame_templates(text: Column) -> Column:
    """array<struct<frame, template>>: the wordings that a text has, in fixed order."""
    low = F.lower(text)
    each = (F.when(low.rlike("(?U)" + template_pattern(t)), F.struct(F.lit(f).alias("frame"), F.lit(t).alias("template"))) for f, ts in L.FRAME_TEMPLATES.items() for t in ts)
    return F.array_compact(F.array(*each))
