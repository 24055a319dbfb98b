"""Near-duplicate records with small edits: bottom-k sketches, inverted lists of retained values, exact Jaccard.

1. Each text becomes the sketch of its snippet set: the K smallest of its hashes under one hash function. Rows whose normalised
   text is the same are one class from here on; only a representative goes on.
2. Every retained value is counted over all representatives. For a pair at or above the threshold the sketches share
   ``least_shared`` of K values but for an error far under one in a thousand, so with each sketch in order of rarity, the pair
   must meet in the first ``size - least_shared + 1`` values of both: only these go into the inverted lists (prefix filtering;
   no list is cut off and no text is dropped), and of these only values that a bitmap of the shared ones doesn't rule out.
3. A list longer than LIST is cut into squares of LIST entries against LIST entries, each a group by itself, so that no task
   holds a list that a third of all texts are in. Within a group, pairs pass if the maps of retained values and the numbers of
   snippets allow the threshold; only those leave the task. Then the union sketch estimates the similarity, and the texts decide.

Defined results: null or short content (< LEAST_CONTENT characters) takes no part; a null title counts as empty; repeated
rows of an article count once, and of an article whose rows differ every text takes part; texts without any snippet pair with
nothing; empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm import fingerprints as P
from framelens.llm.grouped_split import components
from framelens.llm.rows import flat, map_batches, map_rows
from framelens.session import cut, small, spread

K = 64
#: Standard deviations that a number of shared values, or an estimate, may be under its mean.
DEVIATIONS = 3.1
#: Values whose number of sketches is sent out, as the commonest; 16 bytes each.
HOT_VALUES = 150_000
#: Bits of the map of shared values at most (32 MB); beyond some 30 million shared values it rules out fewer and fewer.
MAP_BITS = 2**28
#: Entries of an inverted list that are paired in one group; longer lists are cut into squares.
LIST = 2_000
#: Pairs that a task looks at in one step.
STEP = 2_000_000
#: Classes of equal texts up to this size are written out pair by pair; larger ones as links to their smallest member (which
#: of the two a row is, the size of the class in ``groups`` tells).
STAR_FROM = 64


def least_shared(threshold: float, k: int = K) -> int:
    """Values that the sketches of a pair at the threshold share at least: they are common values among the k smallest of both."""
    return max(1, math.floor(k * threshold - DEVIATIONS * math.sqrt(k * threshold * (1 - threshold))))


def slack(threshold: float, k: int = K) -> float:
    return DEVIATIONS * math.sqrt(threshold * (1 - threshold) / k) + 0.01


def sketches(articles: DataFrame, key: str = "article_id", k: int = K) -> DataFrame:
    """One row a row of at least LEAST_CONTENT characters: key, text hash, number of different snippets, sketch."""

    def run(batches):
        for b in batches:
            out = {c: [] for c in ("key", "c1", "c2", "n", "sketch")}
            for key_, title, content in zip(b["key"], b["title"], b["content"]):
                text = P.normalised(title, content)
                low = (different := P.snippet_set(text))[:k]
                if not len(low):
                    continue
                digest = xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass"))
                row = (key_, (digest >> 64) - 2**63, (digest & (2**64 - 1)) - 2**63, len(different), low.view(np.int64))
                for c, v in zip(out, row):
                    out[c].append(v)
            yield out

    df = articles.where((F.char_length("content") >= P.LEAST_CONTENT) & F.col(key).isNotNull()).select(F.col(key).alias("key"), "title", "content")
    return map_rows(spread(df), run, "key string, c1 bigint, c2 bigint, n bigint, sketch array<bigint>")


def classes(sketched: DataFrame) -> DataFrame:
    """(c1, c2, rep, rid): each class of equal normalised texts, its smallest key and the number of that row."""
    best = sketched.groupBy("c1", "c2").agg(F.min(F.struct("key", "row")).alias("w"))
    return best.select("c1", "c2", F.col("w.key").alias("rep"), F.col("w.row").alias("rid"))


def counted(reps: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(value, n) of the values of more than one sketch; the commonest of them and their numbers, HOT_VALUES at most, sorted."""
    total = reps.agg(F.sum(F.size("sketch"))).first()[0] or 0
    counts = cut(reps.select(F.explode("sketch").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    t = counts.where(F.col("n") * HOT_VALUES > total).toArrow()
    values, n = t.column("value").to_numpy(), t.column("n").to_numpy()
    order = np.argsort(values)
    return counts, values[order], n[order]


def map_of(counts: DataFrame) -> np.ndarray:
    """Bits of the shared values, as many bits as a power of two allows for 16 a value, MAP_BITS at most."""
    n_bits = min(MAP_BITS, 2 ** max(10, (16 * counts.count()).bit_length()))
    bit = F.col("value").bitwiseAND(F.lit(n_bits - 1))
    words = counts.groupBy(F.shiftright(bit, 5).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(31)).cast("int"))).alias("w")).toArrow()
    out = np.zeros(n_bits // 32, dtype=np.uint32)
    out[words.column("at").to_numpy()] = words.column("w").to_numpy().astype(np.uint32)
    return out


def in_map(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.view(np.uint64) & np.uint64(len(bits) * 32 - 1)
    return (bits[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0


POSTING = "value bigint, square int, side int, rid bigint, n bigint, size int, m0 bigint, m1 bigint, m2 bigint, m3 bigint"


def postings(reps: DataFrame, threshold: float, k: int = K) -> DataFrame:
    """The entries of the inverted lists: the values of each sketch that must hold one common to any partner, rarest first.

    The order must be the same for all sketches, no more: values that aren't among the commonest are alike. In a list that
    is too long, an entry comes into each square of its row and column: side 0 in the rows, 1 in the columns, 2 in the square
    of its own part.
    """
    counts, hot, held = counted(reps)
    context = reps.sparkSession.sparkContext
    # lists too long to be one group: their number of parts
    long_lists = counts.where(F.col("n") > LIST).select("value", F.ceil(F.col("n") / LIST).cast("int").alias("parts"))
    sent = context.broadcast((hot, held, map_of(counts)))
    least = least_shared(threshold, k)

    def run(batches):
        hot, held, bits = sent.value
        for b in batches:
            values, lengths = flat(b.column("sketch"))
            size = lengths.astype(np.int64)
            owner, start = np.repeat(np.arange(len(size)), size), np.r_[0, np.cumsum(size)]
            low = values & 255
            maps = np.zeros((len(size), 256), dtype=bool)
            maps[owner, low] = True
            maps = np.packbits(maps, axis=1).view(np.int64)
            n = np.zeros(len(values), dtype=np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, values), len(hot) - 1)
                n = np.where(hot[at] == values, held[at], 0)
            order = np.lexsort((values, n, owner))
            need = np.maximum(1, np.floor(size * least / k)).astype(np.int64)
            picked = order[np.arange(len(values)) - start[owner] < (size - need + 1)[owner]]
            picked = picked[in_map(bits, values[picked])]
            o = owner[picked]
            columns = {"value": values[picked], "square": np.zeros(len(o), np.int32), "side": np.full(len(o), 2, np.int32), "rid": b.column("rid").to_numpy()[o], "n": b.column("n").to_numpy()[o], "size": size[o].astype(np.int32)}
            yield {c: pa.array(x) for c, x in (columns | {f"m{i}": maps[o, i] for i in range(4)}).items()}

    entries = map_batches(reps.select("rid", "n", "sketch"), run, POSTING)
    if long_lists.isEmpty():
        return entries
    own = F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")
    # the square of parts i < j is i * parts + j: all entries of part i are its rows, all of part j its columns
    squares = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct((F.least(own, j) * F.col("parts") + F.greatest(own, j)).cast("int").alias("square"), F.when(own == j, 2).when(own < j, 0).otherwise(1).alias("side")))
    cut_up = entries.drop("square", "side").join(small(long_lists), "value").withColumn("s", F.explode(squares)).select("value", "s.square", "s.side", "rid", "n", "size", "m0", "m1", "m2", "m3")
    return entries.join(small(long_lists), "value", "left_anti").unionByName(cut_up)


def candidates(entries: DataFrame, threshold: float, k: int = K) -> DataFrame:
    """(a, b): pairs of class numbers, a < b, that may reach the threshold."""
    least = least_shared(threshold, k)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def groups(last: bool):
            t = pa.Table.from_batches(held)
            c = {x: t.column(x).to_numpy() for x in t.column_names}
            new = np.flatnonzero((c["value"][1:] != c["value"][:-1]) | (c["square"][1:] != c["square"][:-1])) + 1
            end = t.num_rows if last else int(new[-1]) if len(new) else 0
            if end:
                yield from meeting({x: y[:end] for x, y in c.items()}, np.r_[0, new[new < end], end], threshold, least, k)
            held[:] = t.slice(end).to_batches() if end < t.num_rows else []

        for b in batches:
            if b.num_rows:
                held.append(b)
                if sum(x.num_rows for x in held) >= 4 * LIST:
                    yield from groups(False)
        if held:
            yield from groups(True)

    # more than one partition a core where lists are many; AQE would merge them to few
    sorted_ = entries.repartition("value", "square").sortWithinPartitions("value", "square")
    return map_batches(sorted_, run, "a bigint, b bigint").distinct()


def meeting(c: dict[str, np.ndarray], bounds: np.ndarray, threshold: float, least: int, k: int):
    """Pairs (a, b) within each group that the maps and sizes allow; groups are the stretches between bounds."""
    size = np.diff(bounds)
    # each entry meets those after it in its group
    after = np.repeat(bounds[1:], size) - np.arange(bounds[-1]) - 1
    upto = np.cumsum(after)
    maps = np.stack([c[f"m{i}"].view(np.uint64) for i in range(4)], axis=1)
    i = 0
    while i < len(after):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + STEP, "right")))
        n = after[i:j]
        x = np.repeat(np.arange(i, j), n)
        y = x + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i = j
        # in a square off the diagonal, rows meet columns only
        keep = (c["side"][x] != c["side"][y]) | (c["side"][x] == 2)
        low, high = np.minimum(c["n"][x], c["n"][y]), np.maximum(c["n"][x], c["n"][y])
        keep &= low >= high * threshold  # numbers of different snippets bound the similarity
        x, y = x[keep], y[keep]
        shared = sum(np.bitwise_count(maps[x, q] & maps[y, q]).astype(np.int64) for q in range(4))
        # two different retained values fall on the same bit now and then
        x, y = (z[shared >= np.minimum(c["size"][x], c["size"][y]) * (least / k) * 0.84] for z in (x, y))
        a, b = c["rid"][x], c["rid"][y]
        if len(a):
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield {"a": pa.array(pairs[0][pairs[0] != pairs[1]]), "b": pa.array(pairs[1][pairs[0] != pairs[1]])}


def estimated(pairs: DataFrame, sketched: DataFrame, threshold: float, k: int = K) -> DataFrame:
    """Pairs whose union sketch (the k smallest values of both) holds enough values of both."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    s = sketched.select(F.col("row").alias("rid"), "sketch", F.col("key").alias("rep")).join(small(named), "rid", "left_semi")
    both = pairs.join(s.select(F.col("rid").alias("a"), F.col("sketch").alias("sa"), F.col("rep").alias("rep_a")), "a")
    both = both.join(s.select(F.col("rid").alias("b"), F.col("sketch").alias("sb"), F.col("rep").alias("rep_b")), "b")
    union = F.slice(F.array_sort(F.array_union(F.transform("sa", _unsigned), F.transform("sb", _unsigned))), 1, k)
    inter = F.array_intersect(F.transform("sa", _unsigned), F.transform("sb", _unsigned))
    both = both.withColumn("u", union)
    est = F.size(F.array_intersect("u", inter)) / F.size("u")
    # two texts of one article are no pair; those of two articles may be several
    near = both.where((est >= threshold - slack(threshold, k)) & (F.col("rep_a") != F.col("rep_b")))
    return near.select(F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b")).distinct()


def _unsigned(x):
    """Signed longs in the order of the unsigned hashes."""
    return x.bitwiseXOR(F.lit(-(2**63)))


def with_texts(pairs: DataFrame, articles: DataFrame, key: str = "article_id") -> DataFrame:
    """Adds the texts of both sides, all different ones of an article (its rows are few). Only the articles named in a pair are
    shuffled.

    The set of names is broadcast if it is counted to be small (BROADCAST_ROWS), else joined by shuffle.
    """
    names = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("k")).distinct()
    texts = articles.select(F.col(key).alias("k"), "title", "content").join(small(names), "k", "left_semi")
    t = texts.groupBy("k").agg(F.collect_set(F.struct("title", "content")).alias("t"))
    out = pairs.join(t.select(F.col("k").alias("rep_a"), F.col("t").alias("ta")), "rep_a")
    return out.join(t.select(F.col("k").alias("rep_b"), F.col("t").alias("tb")), "rep_b")


def verified(pairs: DataFrame, articles: DataFrame, threshold: float, key: str = "article_id", containment: bool = False) -> DataFrame:
    """(rep_a, rep_b, similarity) by the whole texts: Jaccard, or the share of a's snippets that b has; of articles with
    several texts the nearest two count."""

    def run(batches):
        for b in batches:
            out = {"rep_a": [], "rep_b": [], "similarity": []}
            seen: dict = {}

            def of(name, t):
                if name not in seen:
                    if len(seen) > 2000:
                        seen.clear()
                    seen[name] = [P.snippet_set(P.normalised(x["title"], x["content"])) for x in t]
                return seen[name]

            def similarity(p, q):
                n = P.common(p, q)
                size = len(p) if containment else len(p) + len(q) - n
                return n / size if size and n >= threshold * size else -1.0

            for x, y, tx, ty in zip(b["rep_a"], b["rep_b"], b["ta"], b["tb"]):
                best = max(similarity(p, q) for p in of(x, tx) for q in of(y, ty))
                if best >= 0:
                    out["rep_a"].append(x)
                    out["rep_b"].append(y)
                    out["similarity"].append(best)
            yield out

    return map_rows(with_texts(pairs, articles, key), run, "rep_a string, rep_b string, similarity double")


def links(articles: DataFrame, threshold: float = 0.8, key: str = "article_id") -> tuple[DataFrame, DataFrame]:
    """(pairs of representatives with their similarity, membership: key, rep). Both rest on written tables."""
    sketched = cut(sketches(articles, key).withColumn("row", F.monotonically_increasing_id()), "sketches")
    named = cut(classes(sketched.select("key", "row", "c1", "c2")), "classes")
    members = cut(sketched.select("key", "c1", "c2").distinct().join(named, ["c1", "c2"]).select("key", "rep").distinct(), "members")
    reps = sketched.select(F.col("row").alias("rid"), "n", "sketch").join(small(named.select("rid")), "rid", "left_semi")
    near = cut(estimated(cut(candidates(postings(reps, threshold), threshold), "candidates"), sketched, threshold), "near")
    return verified(near, articles, threshold, key), members


def groups(articles: DataFrame, threshold: float = 0.8, key: str = "article_id") -> DataFrame:
    """(key, class_id, n_copies, group_id, n_links) of every article that takes part.

    class_id is the smallest key of the articles with the same text, n_copies how many they are; group_id the smallest key that
    can be reached over links at or above the threshold; n_links how many articles are that near, copies included.
    """
    found, members = links(articles, threshold, key)
    found = cut(found.select("rep_a", "rep_b"), "found")
    sizes = cut(members.groupBy("rep").agg(F.count(F.lit(1)).alias("n_copies")), "sizes")
    labels = components(found.select(F.col("rep_a").alias("x"), F.col("rep_b").alias("y"))).withColumnsRenamed({"node": "rep", "label": "group_id"})
    each = found.select(F.explode(F.array(F.struct(F.col("rep_a").alias("rep"), F.col("rep_b").alias("other")), F.struct(F.col("rep_b").alias("rep"), F.col("rep_a").alias("other")))).alias("x")).select("x.*")
    n_links = each.join(sizes.select(F.col("rep").alias("other"), "n_copies"), "other").groupBy("rep").agg(F.sum("n_copies").alias("near"))
    by_class = sizes.join(labels, "rep", "left").join(n_links, "rep", "left")
    out = members.join(by_class, "rep")
    return out.select(F.col("key").alias(key), F.col("rep").alias("class_id"), "n_copies", F.coalesce("group_id", "rep").alias("group_id"), (F.col("n_copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))


def pairs(articles: DataFrame, threshold: float = 0.8, key: str = "article_id") -> DataFrame:
    """(article_id_a, article_id_b), the smaller first: every pair of different texts at or above the threshold with their
    copies, and the pairs within a class of copies (from STAR_FROM members on, as links to the smallest)."""
    found, members = links(articles, threshold, key)
    found = cut(found, "found")
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    copied = members.join(sizes, "rep")
    # members to be written for a class that others link to: all of a small class, else its representative
    shown = copied.where((F.col("size") < STAR_FROM) | (F.col("key") == F.col("rep"))).select("rep", "key")
    a = found.join(shown.withColumnsRenamed({"rep": "rep_a", "key": "key_a"}), "rep_a", "left")
    ab = a.join(shown.withColumnsRenamed({"rep": "rep_b", "key": "key_b"}), "rep_b", "left")
    between = ab.select(F.coalesce("key_a", "rep_a").alias("x"), F.coalesce("key_b", "rep_b").alias("y"))
    star = copied.where((F.col("size") >= STAR_FROM) & (F.col("key") != F.col("rep"))).select(F.col("rep").alias("x"), F.col("key").alias("y"))
    few = copied.where(F.col("size") < STAR_FROM).select("rep", "key")
    within = few.select("rep", F.col("key").alias("x")).join(few.select("rep", F.col("key").alias("y")), "rep").where("x < y").select("x", "y")
    out = between.unionByName(star).unionByName(within)
    return out.select(F.least("x", "y").alias("article_id_a"), F.greatest("x", "y").alias("article_id_b")).distinct()
