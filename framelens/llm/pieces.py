"""Splitting oversized texts at natural boundaries, with an overlap between consecutive pieces.

Sizes are counted in tokens: characters, or the tokens of a public tokenizer. The offset of a token is the prefix sum of the
lengths before it. The positions where a text may be cut are collected once, in order, for four kinds of boundary (ends of
paragraphs and of sentences, blanks, other punctuation), and each gets the number of the token that begins there. The last one
under the limit is found by binary search. Each piece starts with up to ``overlap`` last tokens of the one before; the overlap is
given up where it alone would force a cut inside a word. Only if no boundary at all lies within the limit is the text cut hard,
at the offset of a token.

Defined results: null texts and those within the limit give no piece (``split``: one piece); a text is always read whole;
rows of an article that repeat count once (the latest; a null order comes first).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm import tokens
from framelens.llm.rows import map_rows
from framelens.session import spread

#: The marks at which a text may be cut besides blanks.
MARKS = ".!?。！？।؟።…"
_PARAGRAPH = re.compile(r"\n\s*\n\s*")
_SENTENCE = re.compile(f"[{MARKS}]+[\"”’»)\\]』」）]*\\s*")
_BLANK = re.compile(r"\s+")
_MARK = re.compile(f"[{MARKS}]")


def boundaries(text: str) -> list[list[int]]:
    """Sorted cut positions of each kind, the most natural kind first. A position is where the next piece may begin."""
    return [
        [m.end() for m in _PARAGRAPH.finditer(text)],
        [m.end() for m in _SENTENCE.finditer(text)],
        sorted({p for m in _BLANK.finditer(text) for p in m.span()}),
        sorted({p for m in _MARK.finditer(text) for p in m.span()}),
    ]


def token_starts(text: str, tokens: list[bytes]) -> list[int]:
    """Offsets in characters of tokens that make up the text, from the prefix sums of their lengths in bytes; of a token
    that begins inside a character, the offset of that character."""
    first_bytes = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8) & 0xC0 != 0x80
    begins = np.r_[0, np.cumsum([len(t) for t in tokens])[:-1]] if tokens else np.zeros(0, dtype=np.int64)
    return (np.cumsum(first_bytes)[begins] - 1).tolist()  # characters that have begun at a byte, less one


def _last(at: list[int], low: int, high: int) -> int:
    """Index of the last entry x of a sorted list with low < x <= high, or -1."""
    i = bisect_right(at, high)
    return i - 1 if i and at[i - 1] > low else -1


def split(text: str, limit: int = 3000, overlap: int = 200, starts: list[int] | None = None) -> list[tuple[int, int, bool]]:
    """(start, end, forced) of each piece in characters; forced if it ends in a hard cut.

    starts: the offset of each token, ascending; without it every character is one. limit and overlap are in tokens.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    n = len(text) if starts is None else len(starts)
    if n <= limit:
        return [(0, len(text), False)] if n else []
    places = boundaries(text)
    # the number of the token that begins at or after each boundary
    kinds = places if starts is None else [np.searchsorted(starts, at).tolist() for at in places]

    def whole(token: int, side: str) -> int:
        """The token itself, or if a character is cut there, its first token or the first of the next one."""
        if starts is None or starts[token] != starts[token - 1]:
            return token
        return (bisect_left if side == "left" else bisect_right)(starts, starts[token])

    place = lambda token: token if starts is None else starts[token] if token < n else len(text)
    out: list[tuple[int, int, bool]] = []
    start = fresh = 0  # tokens up to ``fresh`` are in earlier pieces
    at_start = at_fresh = 0  # the same in characters
    while n - start > limit:
        cut = at_cut = -1
        for begin, at_begin in ((start, at_start), (fresh, at_fresh)):
            if n - begin <= limit:  # the rest fits without the overlap
                start, at_start, cut, at_cut = begin, at_begin, n, len(text)
                break
            # a paragraph or sentence end in the last two thirds of the piece is worth a shorter piece; else any blank
            least = fresh + (begin + limit - fresh) // 3
            for k, low in ((0, least), (1, least), (1, fresh), (2, fresh), (3, fresh)):
                if (i := _last(kinds[k], low, begin + limit)) >= 0:
                    cut, at_cut = kinds[k][i], places[k][i]
                    break
            if cut > 0:
                start, at_start = begin, at_begin
                break
        forced = cut < 0
        if forced:
            cut = whole(fresh + limit, "left")
            cut = cut if cut > fresh else whole(fresh + limit, "right")  # a character of more tokens than the limit
            start, at_start, at_cut = fresh, at_fresh, place(cut)
        out.append((at_start, at_cut, forced))
        before, fresh, at_fresh = start, cut, at_cut
        start, at_start = fresh, at_fresh
        if forced or overlap == 0:
            continue
        # the overlap begins at a sentence or blank if one lies in the last tokens before the cut
        inside = [(kinds[k][i], places[k][i]) for k in (1, 2) for i in range(bisect_right(kinds[k], fresh - overlap - 1), bisect_right(kinds[k], fresh - 1))]
        back = min(inside) if inside else (token := whole(fresh - overlap, "right"), place(token))
        if back[0] > before:
            start, at_start = back
    if n > fresh:
        out.append((at_start, len(text), False))
    return out


def pieces(articles: DataFrame, key: str = "article_id", content: str = "content", limit: int = 3000, overlap: int = 200, order: str = "ingested_at", vocabulary: str | None = None) -> DataFrame:
    """(key, piece_no, char_start, char_end, new_start, forced) for each text above the limit. From new_start on the piece is
    new; forced tells that it ends in a hard cut. Sizes are in characters, or with a vocabulary file in its tokens."""

    def run(batches):
        encoding = tokens.encoder(vocabulary) if vocabulary else None
        for b in batches:
            cuts = []
            for t in b["t"]:
                starts = token_starts(t, encoding.decode_tokens_bytes(encoding.encode_ordinary(t))) if encoding else None
                cuts.append(split(t, limit, overlap, starts) if starts is None or len(starts) > limit else [])
            yield {"k": b["k"], "o": b["o"], "p": [[{"s": s, "e": e, "f": f} for s, e, f in c] for c in cuts]}

    # a token has one byte at least, so a text of no more bytes than the limit is within it
    above = F.octet_length(content) > limit if vocabulary else F.char_length(content) > limit
    at = F.col(order).cast("string") if order in articles.columns else F.lit(None).cast("string")
    rows = articles.where(above & F.col(key).isNotNull()).select(F.col(key).alias("k"), at.alias("o"), F.col(content).alias("t"))
    done = map_rows(spread(rows), run, f"k {dict(articles.dtypes)[key]}, o string, p array<struct<s:int,e:int,f:boolean>>")
    latest = done.groupBy("k").agg(F.max_by("p", F.coalesce("o", F.lit(""))).alias("p"))
    flat = latest.select("k", "p", F.posexplode("p").alias("no", "x"))
    new = F.when(F.col("no") == 0, F.lit(0)).otherwise(F.get("p", F.col("no") - 1)["e"])
    return flat.select(F.col("k").alias(key), F.col("no").cast("bigint").alias("piece_no"), F.col("x.s").cast("bigint").alias("char_start"), F.col("x.e").cast("bigint").alias("char_end"), new.cast("bigint").alias("new_start"), F.col("x.f").alias("forced"))
