"""Cleaning, sentences, contexts, groups and statistics: known answers, and agreement with Python's re."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from framelens import lexicons as L
from framelens.functions import features as E
from framelens.functions import segments as G
from framelens.functions import text as X

WORDS = "women men white black hispanic latino asian people of color minority few only just barrier ceiling first CEO Director vice president board c-suite head is was promoted percent 21% 3 times more than less é ñ Überblick lion's share african-american african american women of color black women native".split()


def texts(n=60, seed=3):
    r = random.Random(seed)
    out = ["", " ", "a", "women", "women women", "Women-led, men’s.", "only\n\nonly", 'Smith said, "We are here at last, all of us"', "İstanbul CEO"]
    for _ in range(n):
        ws = [r.choice(WORDS) for _ in range(r.randint(1, 60))]
        out.append("".join(w + r.choice([" ", " ", " ", ". ", ", ", "\n\n", "! ", "? ", "  "]) for w in ws))
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts())] + [(-1, None)], "id int, t string").cache()


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def each(df, column):
    return [(r["t"], r["x"]) for r in df.select("t", column(F.col("t")).alias("x")).collect()]


def test_clean(spark):
    assert one(spark, X.clean_text, "Check out https://example.com for more info") == "Check out for more info"
    assert one(spark, X.clean_text, "This   has \n extra  spaces ") == "This has extra spaces"
    assert one(spark, lambda c: X.clean_text(c, True), "“It’s”") == '"It\'s"'
    assert one(spark, X.clean_text, None) is None


def test_sentences(spark):
    t = "This is sentence one. This is sentence two! Is this sentence three? No."
    assert one(spark, X.sentences, t) == ["This is sentence one.", "This is sentence two!", "Is this sentence three?"]


def test_paragraph_rules_agree(spark):
    t = "A first paragraph that is long.\r\n \r\nA second paragraph, also long.\n\n\nshort\n\nThe third one is long enough."
    want = [p.strip() for p in re.split(r"\n\s*\n|\r\n\s*\r\n|\n{2,}", t) if len(p.strip()) > 20]
    assert one(spark, X.paragraphs, t) == want


@pytest.mark.parametrize(
    ("text", "groups"),
    [
        ("Women and men work together", {"women": ["women"], "men": ["men"]}),
        ("Hispanic and Asian leaders", {"hispanic": ["hispanic"], "asian": ["asian"]}),
        ("woman women wome female", {"women": ["women", "wome", "female"]}),
        ("asian-american asian american", {"asian": ["asian", "asian"]}),
        ("latino latina latin latinx", {"hispanic": ["latino", "latina", "latin", "latinx"]}),
        ("men of color", {"men": ["men"]}),
        ("nothing", {}),
    ],
)
def test_groups(spark, text, groups):
    assert one(spark, X.demographics, text) == groups


def test_groups_that_follow(spark):
    found = one(spark, X.demographics, "Black women face unique challenges compared to white men")
    assert set(found) == {"women", "men", "white", "black", "women_of_color", "white_men", "white_women", "men_of_color"}


def test_statistics(spark):
    t = "Women hold only 21% of leadership positions, which is 3 times less than men."
    found = one(spark, X.statistics, t)
    assert [(s["type"], s["value"], s["direction"]) for s in found] == [("percentage", "21", None), ("comparison", "3", "less")]
    assert found[0]["context"] == t[: t.index("21%") + 53]


def test_candidates_need_whole_words(spark):
    t = "Women are underrepresented in leadership, facing barriers to advancement, but some have achieved breakthrough successes."
    assert set(one(spark, X.frame_candidates, t)) == {"underrepresentation", "successes"}


def test_offsets_are_those_of_finditer(df):
    for pattern in (r"\bonly\b", r"\b\d+\b", r"\b(?:women|men)\b", r"\bis\b"):
        for t, got in each(df, lambda c, p=pattern: X.matches_at(F.lower(c), "(?U)" + p)):
            want = None if t is None else [(m.start(), m.group()) for m in re.finditer(pattern, t.lower())]
            assert (None if got is None else [(g["start"], g["text"]) for g in got]) == want


def test_leadership_contexts(df):
    for t, got in each(df, X.leadership_contexts):
        if t is None or len(t) != len(t.lower()):
            continue
        want = [(term, max(0, m.start() - 100), min(len(t), m.end() + 100)) for term in L.LEADERSHIP_TERMS for m in re.finditer(r"\b" + term + r"\b", t.lower())]
        assert [(g["term"], g["start"], g["end"]) for g in got] == want
        assert all(g["context"] == t[g["start"] : g["end"]] for g in got)


@pytest.mark.parametrize("size", [3, 50])
def test_context_windows_are_those_of_the_pattern(df, size):
    for term in ("only", "women", "less than", "first"):
        for t, got in each(df, lambda c, term=term: X.context_windows(F.lower(c), term, size)):
            if t is not None:
                assert got == re.findall(rf".{{0,{size}}}\b{re.escape(term)}\b.{{0,{size}}}", t.lower())


def test_keyword_segments(df):
    for t, got in each(df, lambda c: G.keyword_segments(c, ("CEO", "Director"), 30)):
        if t is None or len(t) != len(t.lower()):
            continue
        want = []
        for k in ("CEO", "Director"):
            for m in re.finditer(r"\b" + k.lower() + r"\b", t.lower()):
                a, b = max(0, m.start() - 30), min(len(t), m.end() + 30)
                a = p + 1 if (p := t.rfind(".", a, m.start())) >= 0 else a
                b = p + 1 if (p := t.find(".", m.end(), b)) >= 0 else b
                want.append((t[a:b].strip(), k, m.start() - a, a, b, len(want)))
        assert [tuple(g) for g in got] == want


def test_quotes(spark):
    q = one(spark, G.quotes, '"We are making real progress here," said Smith.')
    assert [(x["text"], x["attribution"], x["pattern_id"]) for x in q] == [("We are making real progress here,", "Smith", 1), ("We are making real progress here,", None, 3)]
    q = one(spark, G.quotes, 'Smith said, "We are making real progress here"')
    assert (q[0]["text"], q[0]["attribution"]) == ("We are making real progress here", "Smith")
    q = one(spark, lambda c: G.quotes(c, strict=True), 'Smith said, "We are making real progress here"')
    assert (q[0]["text"], q[0]["attribution"]) == ("Smith", "We are making real progress here")


@pytest.mark.parametrize(("n", "want"), [(0, [(0, -1)]), (2, [(0, 1)]), (3, [(0, 2)]), (4, [(0, 2), (2, 3)]), (5, [(0, 2), (2, 4)]), (6, [(0, 2), (2, 4), (4, 5)]), (7, [(0, 2), (2, 4), (4, 6)])])
def test_windows(spark, n, want):
    w = spark.createDataFrame([([f"s{i}" for i in range(n)],)], "s array<string>").select(G.sliding_windows(F.col("s")).alias("w")).first()["w"]
    assert [(x["start_idx"], x["end_idx"]) for x in w] == want
    assert all(x["sentences"] == [f"s{i}" for i in range(x["start_idx"], x["end_idx"] + 1)] for x in w)


@pytest.mark.parametrize(("size", "overlap"), [(2, 0), (3, 2), (5, 1)])
def test_windows_cover_everything(spark, size, overlap):
    rows = [(n, [str(i) for i in range(n)]) for n in range(1, 25)]
    df = spark.createDataFrame(rows, "n int, s array<string>").select("n", G.sliding_windows(F.col("s"), size, overlap).alias("w"))
    for r in df.collect():
        assert {int(x) for w in r["w"] for x in w["sentences"]} == set(range(r["n"]))
        assert all(b["start_idx"] <= a["end_idx"] + 1 for a, b in zip(r["w"], r["w"][1:]))


def test_windows_check_their_parameters():
    with pytest.raises(ValueError):
        G.sliding_windows(F.lit(None), 2, 2)


def test_fast_counts_are_those_of_one_pattern_a_term(df):
    terms = E.all_terms()
    got = df.where("t is not null").select("t", *(E.count_of(E.found_terms(F.col("t")), [t]).alias(f"f{i}") for i, t in enumerate(terms))).collect()
    for r in got:
        for i, term in enumerate(terms):
            assert r[f"f{i}"] == len(re.findall(r"\b" + re.escape(term) + r"\b", r["t"].lower())), (term, r["t"])


def test_phrase_groups_cannot_overlap():
    for group in E.phrase_groups([t for t in E.all_terms() if not t.isalnum()]):
        for a in group:
            for b in group:
                x, y = re.findall(r"\w+", a), re.findall(r"\w+", b)
                assert a == b or not any(x[i:] == y[: len(x) - i] for i in range(1, len(x)))


def test_number_of_features(spark):
    t = "Women hold only 21% of C-suite positions, facing significant barriers to advancement."
    r = E.with_features(spark.createDataFrame([(t,)], "text string"), keep=[]).first().asDict()
    assert sum(v is not None for v in r.values()) == 71
    empty = E.with_features(spark.createDataFrame([("",)], "text string"), keep=[]).first().asDict()
    assert sum(v is not None for v in empty.values()) + 1 == 69  # the mean over no sentence has no value


def test_linguistic_statistics(spark):
    t = "21% of, 30 percent, 5 percentage, 7%x"
    assert E.with_features(spark.createDataFrame([(t,)], "text string"), kinds=["linguistic"]).first()["ling_statistics_count"] == 3


def test_features_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "women", 7, "x")], "id int, text string, word_count int, _found string")
    assert E.with_features(df).first()["word_count"] == 1


def test_vectors(spark):
    df = spark.createDataFrame([(1, "only few women", None, ["obstacles"]), (2, None, "the first man", None), (3, None, None, [])], "id int, text string, content string, labels array<string>")
    rows = {r["id"]: r for r in E.feature_vectors(df, labels="labels").collect()}
    assert rows[1]["label_vector"] == [0, 0, 1, 0] and rows[2]["label_vector"] == [0, 0, 0, 0]
    assert rows[1]["features"].size == len(E.numeric_features()) == 76
    assert rows[3]["features"].numNonzeros() == 1  # one piece between periods
