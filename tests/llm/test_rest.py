"""Pieces, containers, mixes, grouped splits, template residue, and the registered SQL."""

from __future__ import annotations

import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from framelens.llm import grouped_split as GS
from framelens.llm import mixing as M
from framelens.llm import packing as K
from framelens.llm import pieces as P
from framelens.llm import residue as D

DATA = Path("/root/testdata/sf0.001")


def test_pieces_property():
    r = random.Random(0)
    for _ in range(1500):
        limit, overlap = r.choice([10, 30]), r.choice([0, 3, 5])
        s = "".join(r.choice("aaaaaaaab. \n!") if r.random() < 0.9 else "x" * r.randint(0, 40) for _ in range(r.randint(0, 120)))
        ps = P.split(s, limit, overlap)
        assert all(0 < e - b <= limit for b, e, _ in ps)
        if s:
            assert ps[0][0] == 0 and ps[-1][1] == len(s)
        for (_, b, _), (c, d, _) in zip(ps, ps[1:]):
            assert b - overlap <= c <= b < d
        whole = re.search(r"[^\s.!?。！？।؟።…]{%d,}" % (limit + 1), s) is not None and len(s) > limit
        assert any(f for *_, f in ps) == whole
    with pytest.raises(ValueError):
        P.split("x", 5, 5)


def test_pieces_prefer_sentence_ends():
    t = "One two three four five. " * 40
    assert all(t[:e].endswith(". ") for _, e, _ in P.split(t, 100, 20)[:-1])


def test_pieces_table(spark):
    rows = [("a", "word " * 2000, 1), ("a", "word " * 2000, 2), ("b", "x" * 7000, 1), ("c", "short", 1), ("d", None, 1), (None, "x" * 4000, 1)]
    df = spark.createDataFrame(rows, "article_id string, content string, ingested_at int")
    got = P.pieces(df).collect()
    assert {(r["article_id"], r["forced"]) for r in got} == {("a", False), ("b", True), ("b", False)}
    assert all(r["char_end"] - r["char_start"] <= 3000 and r["char_start"] <= r["new_start"] for r in got)
    assert P.pieces(df.limit(0)).count() == 0


def slow_best_fit(sizes, capacity):
    bins, out = [], {}
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        fits = [(room, i) for i, room in enumerate(bins) if room >= sizes[k]]
        if fits:
            i = min(fits)[1]
        else:
            bins.append(capacity)
            i = len(bins) - 1
        bins[i] -= sizes[k]
        out[k] = i
    return bins


def test_best_fit_decreasing_leaves_what_the_slow_one_leaves():
    r = random.Random(1)
    for capacity in (1, 7, 64, 100):
        for _ in range(60):
            sizes = [r.randint(1, capacity) for _ in range(r.randint(0, 80))]
            used = Counter()
            for b, s in zip(K.best_fit_decreasing(sizes, capacity), sizes):
                used[b] += s
            assert sorted(capacity - u for u in used.values()) == sorted(slow_best_fit(sizes, capacity))


def test_packing(spark):
    r = random.Random(2)
    rows = [(i, r.choice([0, 5, 2048, 2049, 5000, r.randint(1, 2048)]), 9) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, part int")
    packed = K.pack(df, per_shard=300).collect()
    used, whole = Counter(), Counter()
    for p in packed:
        used[p["container"]] += p["size"]
        whole[p["doc_id"]] += p["size"]
    assert max(used.values()) <= 2048 and dict(whole) == {i: n for i, n, _ in rows if n}
    assert {p["doc_id"] for p in packed if p["part"] > 0} == {i for i, n, _ in rows if n > 2048}
    parts = [p["size"] for p in packed]
    assert len(used) <= 1.02 * len(slow_best_fit(parts, 2048)) + 3  # what the sharding costs
    again = {(p["doc_id"], p["part"]): p["container"] for p in K.pack(df.repartition(7), per_shard=300).collect()}
    assert again == {(p["doc_id"], p["part"]): p["container"] for p in packed}
    assert K.pack(df.limit(0)).count() == 0 and K.fill(K.pack(df.limit(0))).first()["n_containers"] == 0


def documents(spark):
    r = random.Random(3)
    rows = []
    for i in range(300):
        rows.append((i, " ".join(str(r.randint(0, 999)) for _ in range(r.randint(5, 60))), r.choice(["Echo", " echo ", "ECHO", "Ledger", "Tiny", None]) if i % 50 else "Tiny", i))
    rows += [(1000, None, "Echo", 0), (1001, "  ", "Echo", 0), (1002, rows[7][1], "Ledger", 0), (None, "no key", "Echo", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, uses int")


TARGETS = [("echo", 0.5, 2), ("Ledger ", 0.3, 1), ("tiny", 0.15, 4), ("Absent", 0.05, 3), ("tiny", 0.15, 4)]


def test_mix_reaches_its_shares(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats long")
    rows = M.shares(documents(spark), targets).collect()
    s = {r["source"]: r for r in rows}
    assert set(s) == {"echo", "ledger", "tiny", "absent"} and s["absent"]["tokens"] == 0
    rest = sum(r["target_share"] for r in rows if r["tokens"])
    for r in rows:
        assert r["most_uses"] <= r["max_repeats"]
        if r["tokens"]:
            assert abs(r["reached_share"] - r["target_share"] / rest) < 0.02
    used = M.mix(documents(spark), targets).collect()
    assert not {r["doc_id"] for r in used} & {1000, 1001, 1002, None} and len(used) == len({r["doc_id"] for r in used})
    one = {(r["doc_id"], r["uses"]) for r in used}
    assert one == {(r["doc_id"], r["uses"]) for r in M.mix(documents(spark).repartition(9), targets).collect()}


def test_mix_with_ranges_total_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE_TEXTS", 20)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats long")
    rows = {r["source"]: r for r in M.shares(documents(spark), targets, total=2000).collect()}
    assert abs(rows["echo"]["tokens"] - 1000) < 200 and abs(rows["ledger"]["tokens"] - 600) < 200
    assert M.mix(documents(spark).limit(0), targets).count() == 0
    assert M.shares(documents(spark).limit(0), targets).count() == 4
    assert M.mix(documents(spark), targets.limit(0)).count() == 0


def brute_groups(rows, mapping):
    known = {v.strip().lower(): s.strip().lower() for v, s in mapping if v}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, s, by, *_ in rows:
        if a is None:
            continue
        find(a)
        values = []
        if s and s.strip():
            values.append("s:" + known.get(s.strip().lower(), s.strip().lower()))
        bare = re.sub(r"^by\b[ :]*", "", re.sub(r"\s+", " ", by or "").strip().lower())
        values += ["a:" + n.strip() for n in re.split(r" and |;|&", bare) if n.strip() and n.strip() not in GS.NOBODY]
        for v in values:
            parent[find(v)] = find(a)
    out = {}
    for a in {r[0] for r in rows if r[0] is not None}:
        out.setdefault(find(a), []).append(a)
    return {x: min(g) for g in out.values() for x in g}


def test_groups_and_splits(spark):
    r = random.Random(6)
    rows = []
    for i in range(400):
        source = r.choice([None, "", "Hot Source", " hot source", *(f"s{k}" for k in range(150))])
        by = r.choice([None, "Staff", "By  Newsroom", "", *(f"By A{r.randint(0, 250)} and  B{r.randint(0, 250)}" for _ in range(2)), f"a{r.randint(0, 250)}; C & D{i}"])
        rows.append((f"x{i:04}", source, by, "clash"))
    rows += rows[:20] + [(None, "s1", "A1", "")]
    mapping = [("S1", "s2"), ("s3 ", "S2"), (None, "s9")]
    a = spark.createDataFrame(rows, "article_id string, source string, author string, node string")
    g = GS.groups(a, spark.createDataFrame(mapping, "variant string, source string"))
    got = {x["article_id"]: x["group_id"] for x in g.collect()}
    assert got == brute_groups(rows, mapping)
    s = GS.splits(g).collect()
    assert len({(x["group_id"], x["split"]) for x in s}) == len({x["group_id"] for x in s}) and len(s) == 400


def test_long_chain_and_proportions(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500)], "x long, y long")
    got = {r["node"]: r["label"] for r in GS.components(chain).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500}
    sizes = [900, 300, 50, 50] + [1] * 1700
    g = spark.createDataFrame([(f"{k}-{i}", f"g{k:05}") for k, n in enumerate(sizes) for i in range(n)], "article_id string, group_id string")
    n = Counter(r["split"] for r in GS.splits(g).collect())
    assert all(abs(n[s] / sum(sizes) - w) < 0.002 for s, w in GS.SHARES.items())
    e = g.limit(0)
    assert GS.splits(e).count() == 0


CASES = {
    "Page not found (404)\nHome | Menu": True,
    "The board of Acme\n\nPlease enable JavaScript to continue.": True,
    "Lorem ipsum dolor sit amet consec adipis elit sed eius tempor. " * 9: True,
    "jjfdk hljhlkl kmmkz qwery tyuiop xxxx jjkl asdf": True,
    "Dear {{ first_name }}, the women of Garmi hold only 3 seats on the board.": True,
    "The women of [CITY] hold only 3 seats on the board of Acme Inc. since 2001.": True,
    "このページを表示するにはJavaScriptを有効にしてください。": True,
    "Titular de prueba.\n\nTexto de relleno.": True,
    "The newsletter greeted 90 women as “{{first_name}}”, which she called a mistake.": False,
    "For 16 hours readers saw “Page not found (404)” instead of the story, she said.": False,
    "The women of Garmi hold only 3 seats on the board.\n\nPlease enable JavaScript to view the comments.": False,
    "Home | Menu\nSearch\n\nThe women of Garmi hold only 3 seats [sic] on the board {1, 2}.": False,
    "A heading": False,
    "": False,
    "  \n": False,
}


def test_residue(spark):
    rows = [(i, t, "s", "x") for i, t in enumerate(CASES)] + [(900, None, None, "x"), (None, "Page not found (404)", "s", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, line string")
    got = {r["doc_id"] for r in D.found(df).collect()}
    assert got == {i for i, (_, bad) in enumerate(CASES.items()) if bad}
    assert D.without(df.where("doc_id is not null"), "doc_id").count() == len(rows) - 1 - len(got)
    assert D.found(df.limit(0)).count() == 0


def test_masks_make_equal_messages_equal():
    assert D.masked("Error 404: see https://a.example/x?y=1 or a@b.example at 10:30 on 2020-01-02") == D.masked("Error 500: see http://b.example/zz or c@d.example at 9:15 on 1999-12-31")
    assert D.classify("Zurück zur Liste.", 5) == "furniture" and D.classify("Zurück zur Liste.", 1) == "article"


def test_sizes_of_texts(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, " \n"), (4, "x " * 50_000)], "doc_id long, text string")
    n = {r["doc_id"]: r["n_tokens"] for r in K.sized(df).collect()}
    assert set(n) == {1, 4} and n[1] == 2 and n[4] >= 50_000


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_queries_equal_their_sql(spark):
    import duckdb

    from framelens.llm import oracles, queries

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    for name, sql in oracles.ORACLES.items():
        df = queries.queries()[name](spark, str(DATA))
        res = con.execute(sql)
        cols = [c[0] for c in res.description]
        assert sorted(tuple(r) for r in df.select(*cols).collect()) == sorted(res.fetchall()), name


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_every_query_runs(spark):
    from framelens.llm import queries

    for name, q in queries.queries().items():
        q(spark, str(DATA)).agg(F.count(F.lit(1))).collect()
        assert re.match(r"p\d+_", name)


def test_recurring_messages_are_judged_by_their_group(spark):
    foreign = "El contenido ya no está disponible."
    rows = [(i, foreign, f"s{i}") for i in range(3)] + [(9, "Nuestro informe ya no está en la lista de hoy", "s9")]
    cases = lambda rows: {r[0] for r in D.found(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert cases(rows) == {0, 1, 2}
    # no phrase of the second route: in one source only it isn't known for a message
    assert cases([(i, foreign, "s") for i in range(3)]) == set()


def test_length_settles_nothing(spark):
    notice = "We’re sorry, but the page you are looking for could not be found. " + "Please go back to the front page and try again. " * 6
    filler = "Sed ut enim minim veniam nostrud ullamco nisi commodo duis aute irure. " * 9
    article = notice + "The council of the town said on Monday that more than half of its new members are women from the northern districts."
    rows = [(1, notice, "a"), (2, filler, "b"), (3, article, "c"), (4, "Здесь будет текст. " * 2, "d"), (5, None, "e"), (6, " \n ", None)]
    assert {r[0] for r in D.found(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()} == {1, 2, 4}
    assert D.is_gibberish("Sed ut enim minim veniam nostrud ullamco nisi commodo duis aute irure.")


def test_pieces_in_tokens():
    from framelens.llm import tokens as T

    encoding = T.encoder(T.vocabulary_path())
    texts = ["The council met. It fined Zürich €5 – twice. " * 60, "महिलाओं के पास केवल 19% पद हैं। " * 60, "日本の女性管理職は四人に達した。" * 80, "x" * 4000, "👩🏽‍💼" * 300, "ab"]
    for text in texts:
        parts = encoding.decode_tokens_bytes(encoding.encode_ordinary(text))
        starts = P.token_starts(text, parts)
        assert len(starts) == len(parts) and starts == sorted(starts)
        for limit, overlap in ((100, 10), (40, 0), (7, 3)):
            covered = 0
            for a, b, forced in P.split(text, limit, overlap, starts):
                inside = sum(a <= x < b for x in starts)
                assert a <= covered < b and inside <= limit
                assert sum(a <= x < covered for x in starts) <= overlap
                covered = b
            assert covered == len(text)
    assert P.split("", 10, 2, []) == []


def test_token_pieces_of_a_table(spark):
    rows = [(1, "A sentence of some words. " * 200, "c"), (2, None, "c"), (3, "", "c"), (4, "short", "c"), (1, "A sentence of some words. " * 200, "c")]
    from framelens.llm import tokens as T

    df = spark.createDataFrame(rows, "doc_id bigint, text string, start string")
    got = P.pieces(df, "doc_id", "text", 100, 10, "fetched_at", T.vocabulary_path()).orderBy("piece_no").collect()
    assert {r["doc_id"] for r in got} == {1} and got[0]["char_start"] == 0 and got[-1]["char_end"] == len(rows[0][1]) and not any(r["forced"] for r in got)
    assert [r["piece_no"] for r in got] == list(range(len(got)))


def test_shards_lose_little(spark):
    r = random.Random(6)
    items = spark.createDataFrame([(i, r.choice([r.randint(1, 60), r.randint(1, 2048)])) for i in range(3000)], "doc_id long, n_tokens long")
    used = {}
    for per_shard in (3000, 1000):
        packed = K.pack(items, per_shard=per_shard)
        whole = packed.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id", "part").alias("d"), F.sum("size").alias("s")).first()
        assert whole["n"] == whole["d"] == 3000 and whole["s"] == items.agg(F.sum("n_tokens")).first()[0]
        fill = K.fill(packed).first()
        assert fill["fullest"] <= 2048
        used[per_shard] = fill["n_containers"]
    assert used[1000] <= 1.005 * used[3000]
