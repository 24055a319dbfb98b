"""Garbled text from a wrong character encoding: found, explained by clean near-twins, and restored.

1. Every text is scanned once. A run of non-ASCII characters is known by its place in the text stripped of non-ASCII characters and
   blanks: by WINDOW characters around it and its offset in them. Near-twins have most of these places in common, whatever
   their edits, and so have texts that share a passage.
2. The runs of texts that look garbled are joined with the clean runs of the same place (one for each place, combined before
   the join; places where clean texts differ teach nothing). This aligns the characters and shows what was written.
3. The aligned pairs, counted, teach two things: transformations (wrong codec > true codec) that explain the pairs, and a map
   of runs for what no codec explains, such as replacement characters.
4. A text is a case because a twin shows it, or because a learned transformation or run is in it. Scripts that leave nothing
   to align (a page of Chinese has no ASCII places), and transformations too rare in a corpus to have twins, can't be learned
   so: their texts are cases only if they decode strictly and at length (more than one run, or more than two characters).
   ``ways`` counts all three.
5. Restoring: runs with a twin take the twin's characters, other runs the learned transformation, then the learned map.

The codec tables (``garble``) only say which texts to hold against twins and how a learned transformation is undone.

Defined results: null and empty fields are no case; a text is always read whole; each (key, field) comes once however many
rows an article has; a replacement character is a case that only a twin or the map can restore.
"""

from __future__ import annotations

from itertools import count

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm import garble as G
from framelens.llm.rows import map_rows
from framelens.session import cut, small, spread

#: ASCII characters around a run, besides blanks, that tell its place from others.
WINDOW = 24
#: Pairs that must show a transformation, and the share of all aligned pairs of its runs that it must explain.
LEAST_PAIRS, LEAST_EXPLAINED = 2, 0.5

RUN_TYPE = "struct<no:int,h:bigint,run:string,kind:string,back:string>"
SCAN = f"key string, field string, t bigint, at string, kinds array<string>, strong boolean, runs array<{RUN_TYPE}>"


def places(text: str) -> list[tuple[int, int, str]]:
    """(number, hash of the place, run) of the runs of a text that have a place to themselves."""
    found = list(G.RUN.finditer(text))
    if not found:
        return []
    parts, at, last, n = [], [], 0, 0
    for m in found:
        parts.append("".join(text[last : m.start()].split()).lower())
        n += len(parts[-1])
        at.append(n)
        last = m.end()
    parts.append("".join(text[last:].split()).lower())
    bare = "".join(parts)
    out = []
    for no, (m, p) in enumerate(zip(found, at)):
        if (no and at[no - 1] == p) or (no + 1 < len(at) and at[no + 1] == p):
            continue  # only blanks between two runs
        low = max(0, min(p - WINDOW // 2, len(bare) - WINDOW))
        window = bare[low : low + WINDOW]
        if len(window) == WINDOW:
            out.append((no, xxhash.xxh3_64_intdigest(f"{p - low}|{window}") - 2**63, m.group()))
    return out


def proposal(run: str) -> tuple[str, str]:
    """(transformation, text as written) that the codec tables propose for a run; empty if none."""
    if (hit := G.utf8_misread(run)) is not None:
        return f"{hit[0]}>utf-8", G.restore(hit[1]) or ""
    if (old := G.legacy_misread(run)) is not None:
        return f"{old[0]}>{old[1]}", old[2]
    return "", ""


def scan(articles: DataFrame, key: str = "article_id", fields: tuple[str, ...] = ("title", "content"), order: str = "ingested_at") -> DataFrame:
    """Rows of two kinds: one a field that looks garbled, and, without a key, the clean runs of a batch of texts by place."""

    def run(batches):
        for b in batches:
            out = {c: [] for c in ("key", "field", "t", "at", "kinds", "strong", "runs")}
            clean: dict[tuple[int, str], None] = {}
            for field in fields:
                for k, text, t, at in zip(b["key"], b[field], b[f"t_{field}"], b["at"]):
                    if not text or (text.isascii() and "&" not in text):
                        continue
                    hits = G.suspects(text)
                    if not hits:
                        clean.update(dict.fromkeys((h, r) for _, h, r in places(text)))
                        continue
                    plain = G.html.unescape(text) if "&" in text else text
                    runs = [(no, h, r, *proposal(r)) for no, h, r in places(plain)]
                    row = (k, field, t, at, sorted({h[0].removeprefix("html:") for h in hits}), len(hits) > 1 or any(h[0] == "lost" or h[0].startswith("html:") or len(h[1]) > 2 for h in hits))
                    for c, v in zip(out, (*row, [dict(zip(("no", "h", "run", "kind", "back"), r)) for r in runs])):
                        out[c].append(v)
            if clean:
                for c, v in zip(out, (None, None, None, None, None, None, [{"no": 0, "h": h, "run": r, "kind": "", "back": ""} for h, r in clean])):
                    out[c].append(v)
            yield out

    at = F.col(order).cast("string") if order in articles.columns else F.lit(None).cast("string")
    df = articles.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), at.alias("at"), *fields, *(F.xxhash64(f).alias(f"t_{f}") for f in fields))
    return map_rows(spread(df), run, SCAN)


def _garbled(scanned: DataFrame) -> DataFrame:
    return scanned.where("key is not null")


def clean_runs(scanned: DataFrame) -> DataFrame:
    """(h, clean): what clean texts have at a place, if they agree."""
    runs = scanned.where("key is null").select(F.explode("runs").alias("r")).groupBy(F.col("r.h").alias("h")).agg(F.min("r.run").alias("clean"), F.max("r.run").alias("other"))
    return runs.where("clean = other").select("h", "clean")


def twins(scanned: DataFrame) -> DataFrame:
    """(key, field, t, no, run, kind, back, clean): garbled runs whose place has another run in clean texts."""
    runs = _garbled(scanned).select("key", "field", "t", F.explode("runs").alias("r")).select("key", "field", "t", "r.*")
    return runs.join(clean_runs(scanned), "h").where("run <> clean").drop("h")


def aligned(scanned: DataFrame) -> DataFrame:
    """(run, clean, kind, explained, n): aligned pairs, whether their transformation explains them, and how often they are."""
    return _aligned(twins(scanned))


def _aligned(found: DataFrame) -> DataFrame:
    return found.groupBy("run", "clean", "kind", (F.col("back") == F.col("clean")).alias("explained")).agg(F.count(F.lit(1)).alias("n"))


def learned_kinds(pairs: DataFrame) -> DataFrame:
    """(kind): transformations that explain LEAST_PAIRS pairs and more, and most of the pairs they are proposed for."""
    by = pairs.where("kind <> ''").groupBy("kind").agg(F.sum(F.when(F.col("explained"), F.col("n")).otherwise(0)).alias("good"), F.sum("n").alias("n"))
    return by.where((F.col("good") >= LEAST_PAIRS) & (F.col("good") >= LEAST_EXPLAINED * F.col("n"))).select("kind")


def learned_runs(pairs: DataFrame) -> DataFrame:
    """(run, clean): runs that no transformation explains, with what they nearly always stand for."""
    best = pairs.where("not explained").groupBy("run").agg(F.max_by("clean", "n").alias("clean"), F.max("n").alias("top"), F.sum("n").alias("n"))
    return best.where("top >= 2 and top >= 0.8 * n").select("run", "clean")


def _cases(scanned: DataFrame, found: DataFrame, pairs: DataFrame) -> DataFrame:
    """The garbled rows that are cases, with ``way``: twin, mapping or codec."""
    kinds = pairs.sparkSession.createDataFrame([(list({r["kind"] for r in learned_kinds(pairs).collect()}),)], "learned array<string>")  # at most one a pair of codecs: some thirty
    mapped = _garbled(scanned).select("key", "field", "t", F.explode("runs.run").alias("run")).join(small(learned_runs(pairs)), "run", "left_semi").select("key", "field", "t").distinct()
    shown = found.where("back = clean or kind = ''").select("key", "field", "t").distinct()
    flagged = _garbled(scanned).join(F.broadcast(kinds)).join(shown.withColumn("shown", F.lit(True)), ["key", "field", "t"], "left").join(mapped.withColumn("mapped", F.lit(True)), ["key", "field", "t"], "left")
    by_kind = F.size(F.array_intersect("kinds", "learned")) > 0
    way = F.when(F.col("shown"), "twin").when(by_kind | F.col("mapped"), "mapping").when(F.col("strong"), "codec")
    return flagged.withColumn("way", way).where("way is not null").drop("learned", "shown", "mapped")


def _learned(articles: DataFrame, key: str, fields: tuple[str, ...], order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    scanned = cut(scan(articles, key, fields, order), "scan")
    found = cut(twins(scanned), "twins")
    pairs = cut(_aligned(found), "aligned")
    return _cases(scanned, found, pairs), found, pairs


def found(articles: DataFrame, key: str = "article_id", fields: tuple[str, ...] = ("title", "content"), order: str = "ingested_at") -> DataFrame:
    """(key, field) of every garbled field, restorable or not."""
    return _learned(articles, key, fields, order)[0].select(F.col("key").alias(key), "field").distinct()


def ways(articles: DataFrame, key: str = "article_id", fields: tuple[str, ...] = ("title", "content"), order: str = "ingested_at") -> DataFrame:
    """(way, kind, n): fields by the way they were found, and their first transformation."""
    cases = _learned(articles, key, fields, order)[0]
    first = cases.groupBy("key", "field").agg(F.max("way").alias("way"), F.min(F.element_at("kinds", 1)).alias("kind"))
    return first.groupBy("way", "kind").agg(F.count(F.lit(1)).alias("n"))


def restored(articles: DataFrame, key: str = "article_id", fields: tuple[str, ...] = ("title", "content"), order: str = "ingested_at") -> DataFrame:
    """(key, field, restored, complete): the text as written of each garbled field; complete tells if nothing is left to
    restore. Where an article has several garbled rows, the latest is taken (null orders first)."""
    cases, found_, pairs = _learned(articles, key, fields, order)
    latest = cut(cases.groupBy("key", "field").agg(F.max(F.struct("at", "t")).alias("x")).select("key", "field", "x.t"), "cases")
    # runs of one text
    own = found_.join(latest, ["key", "field", "t"]).groupBy("key", "field", "t").agg(F.map_from_entries(F.collect_set(F.struct("no", "clean"))).alias("twins"))
    learned = cut(learned_runs(pairs), "learned")
    texts = articles.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text"), F.xxhash64(f).alias("t")) for f in fields))).alias("x"))
    texts = texts.select("key", "x.*").join(small(latest), ["key", "field", "t"], "left_semi").groupBy("key", "field", "t").agg(F.min("text").alias("text"))

    def undo(batches):
        for b in batches:
            out = {c: [] for c in ("key", "field", "restored", "open")}
            for k, f, text, twins_ in zip(b["key"], b["field"], b["text"], b["twins"]):
                back = repair(text, dict(twins_ or []))
                for c, v in zip(out, (k, f, back, sorted(set(G.RUN.findall(back))) if G.suspects(back) else None)):
                    out[c].append(v)
            yield out

    undone = cut(map_rows(texts.join(own, ["key", "field", "t"], "left"), undo, "key string, field string, restored string, open array<string>"), "undone")
    left = undone.select("key", "field", F.explode("open").alias("run")).join(small(learned), "run")
    # one group is one text's own runs
    maps = left.groupBy("key", "field").agg(F.map_from_entries(F.collect_list(F.struct("run", "clean"))).alias("map"))

    def run(batches):
        for b in batches:
            out = {c: [] for c in ("key", "field", "restored", "complete")}
            for k, f, back, open_, pairs_ in zip(b["key"], b["field"], b["restored"], b["open"], b["map"]):
                if pairs_:
                    back = G.RUN.sub(lambda m, known=dict(pairs_): known.get(m.group(), m.group()), back)
                for c, v in zip(out, (k, f, back, open_ is None or bool(pairs_) and not G.suspects(back))):
                    out[c].append(v)
            yield out

    done = map_rows(undone.join(maps, ["key", "field"], "left"), run, "key string, field string, restored string, complete boolean")
    return done.withColumnRenamed("key", key)


def repair(text: str, twins: dict[int, str]) -> str:
    """Runs with a twin, by their number in the text, take its characters; the rest is undone by codec."""
    plain = G.html.unescape(text) if "&" in text and G.ENTITY.search(text) else text
    if twins:
        numbers = count()
        plain = G.RUN.sub(lambda m: twins.get(next(numbers), m.group()), plain)
    return G.restore(plain) or ""
