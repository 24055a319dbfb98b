"""Checks of a corpus, languages, wordings of frames, weights of terms, the loader."""

from __future__ import annotations

import importlib
import logging
import math
import sys

import pytest
from pyspark.sql import functions as F

from framelens import report
from framelens.functions import language as N
from framelens.operators import analyze as A
from framelens.operators import corpus as C
from framelens.operators import detect as D
from framelens.operators import evaluate as V
from framelens.sources import articles as S

SCHEMA = "article_id string, source string, date string, title string, content string, human_coding map<string,map<string,double>>, kind string, n int"


def table(spark, *rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def test_validation_counts(spark):
    df = table(spark, ("a", "s", None, None, None, {"obstacles": {"women": 1.0, "men": None}, "successes": None}), ("b", None, None, None, "x", None), ("c", "s", None, None, "", {"obstacles": {}}))
    got = {(r["kind"], r["name"]): r["n"] for r in C.validation_counts(df).collect()}
    assert got == {("source", "s"): 2, ("source", None): 1, ("frame", "obstacles"): 2, ("group", "women"): 1, ("group", "men"): 1}
    assert C.validation_counts(df.limit(0)).count() == 0


def test_incomplete_rows(spark):
    df = table(spark, ("a", "s", "d", "t", "c", {}), ("b", None, "d", "t", None, None), (None, "s", "d", "t", "c", {}))
    assert {(r["article_id"], tuple(r["missing"])) for r in S.incomplete(df).collect()} == {("b", ("source", "content", "human_coding")), (None, ("article_id",))}
    assert {tuple(r["missing"]) for r in S.incomplete(df.drop("title")).collect()} == {("title",), ("source", "title", "content", "human_coding"), ("article_id", "title")}
    assert S.missing_fields(df.drop("human_coding", "date")) == ["date", "human_coding"]


def test_quality(spark):
    long = "The board of the town said that the women and men of it are in the majority for the first time. " * 2
    rows = [("a", long), ("b", long.replace(" ", "  ")), ("c", long[:50]), ("d", None), ("e", long + "�"), ("f", "Der Rat der Stadt sagt nicht, dass die Frauen auf dem Weg von der Bank sind, und das ist ein Problem für die Männer im Ort."), ("g", "x y " * 20_000), ("h", ""), ("i", long.replace(".", "\x03"))]
    df = table(spark, *((k, "s", "d", "t", c, None) for k, c in rows))
    got = {}
    for r in C.quality_issues(df).collect():
        got.setdefault(r["article_id"], set()).add(r["issue"])
    assert got == {"b": {"duplicate"}, "c": {"too short"}, "d": {"too short"}, "e": {"encoding"}, "f": {"language"}, "g": {"too long"}, "h": {"too short"}, "i": {"encoding"}}
    assert {r["article_id"] for r in C.without_duplicates(df).collect()} == {k for k, _ in rows} - {"b"}
    assert C.quality_issues(df.limit(0)).count() == 0


LANGUAGES = {
    "The board said that women are in the majority for the first time.": "en",
    "Der Rat sagt nicht, dass die Frauen auf dem Weg sind.": "de",
    "Les femmes dans le conseil ne sont pas plus que la moitié des membres.": "fr",
    "El consejo de la ciudad no fue con las mujeres por una semana.": "es",
    "Совет города сказал, что женщин больше.": "ru",
    "市議会は女性が多いと述べた。": "ja",
    "市议会表示女性占多数。": "zh",
    "قال مجلس المدينة إن النساء أكثر": "ar",
    "नगर परिषद ने कहा कि महिलाएं अधिक हैं": "hi",
    "สภาเมืองกล่าวว่าผู้หญิงมีมากกว่า": "th",
    "የከተማው ምክር ቤት ሴቶች ይበልጣሉ አለ": "am",
    "12 34 – !": None,
    "": None,
    "xyzzy plugh": None,
}


def test_languages(spark):
    df = spark.createDataFrame([*LANGUAGES.items(), (None, None)], "t string, want string").withColumn("l", N.language(F.col("t")))
    for r in df.collect():
        assert (r["l"] and r["l"]["lang"]) == r["want"], r["t"]
        assert r["l"] is None or 0 < r["l"]["score"] <= 1


def test_frame_templates(spark):
    texts = {
        "Of the leaders, only 12.5% are women, he said.": [("underrepresentation", "only X% are [demographic]")],
        "Black women  remain\noverrepresented. Few women of color hold CEO positions": [("underrepresentation", "few [demographic] hold [leadership position]"), ("overrepresentation", "[demographic] remain overrepresented")],
        "70 percent of board seats; 70% of executive roles are held by white men": [("overrepresentation", "X% of [leadership positions] are held by [demographic]")],
        "Women are up against a glass ceiling": [("obstacles", "[demographic] are up against [obstacle metaphor]")],
        "It only hires 5% who are womenfolk": [],
        "": [],
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("f", N.frame_templates(F.col("t")))
    for r in df.collect():
        assert [tuple(x) for x in r["f"]] == texts[r["t"]], r["t"]


def test_tfidf_against_its_definition(spark):
    docs = {"a": "Women lead, women board a x", "b": "women board", "c": "", "d": None, "e": "board BOARD board"}
    df = spark.createDataFrame(list(docs.items()), "article_id string, content string")
    got = {(r["article_id"], r["term"]): r for r in C.tfidf(df, 4).collect()}
    grams = {"a": ["women", "lead", "women", "board", "women lead", "lead women", "women board"], "b": ["women", "board", "women board"], "c": [], "e": ["board"] * 3 + ["board board"] * 2}
    total = {}
    for g in grams.values():
        for t in g:
            total[t] = total.get(t, 0) + 1
    terms = sorted(total, key=lambda t: (-total[t], t))[:4]
    idf = {t: math.log((1 + 4) / (1 + sum(t in g for g in grams.values()))) + 1 for t in terms}
    want = {}
    for k, g in grams.items():
        raw = {t: g.count(t) * idf[t] for t in terms if t in g}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        want |= {(k, t): v / norm for t, v in raw.items()}
    assert set(got) == set(want) and all(abs(got[k]["weight"] - v) < 1e-12 for k, v in want.items())
    assert C.tfidf(df.limit(0)).count() == 0


def test_head_and_folds(spark):
    df = spark.createDataFrame([(f"k{i:02}", i) for i in range(40)], "article_id string, fold int")
    assert [r["article_id"] for r in C.head(df).collect()] == [f"k{i:02}" for i in range(5)]
    folds = {r["article_id"]: r["fold"] for r in C.folds(df).collect()}
    assert set(folds.values()) == set(range(5)) and folds == {r["article_id"]: r["fold"] for r in C.folds(df.repartition(3)).collect()}


def test_loader_reads_once(spark, tmp_path):
    path = str(tmp_path / "a.parquet")
    table(spark, ("a", "s", None, None, "two words", None), ("b", "t", None, None, None, None)).write.parquet(path)
    loader = S.Articles(spark, path)
    assert loader.load() is loader.load() and loader.articles("s") is loader.articles("s")
    assert [(r["article_id"], r["word_count"]) for r in loader.articles("s").collect()] == [("a", 2)]
    with pytest.raises(FileNotFoundError):
        S.Articles(spark, str(tmp_path / "none.json")).load()


def test_logging_is_set_up_once(tmp_path):
    own = logging.getLogger("framelens")
    before = list(own.handlers)
    report.setup_logging("warning", str(tmp_path / "log.txt"))
    report.setup_logging("info", str(tmp_path / "log.txt"))
    report.log.info("said once")
    added = [h for h in own.handlers if h not in before]
    for h in added:
        own.removeHandler(h)
        h.close()
    assert len(added) == 2 and (tmp_path / "log.txt").read_text(encoding="utf-8").count("said once") == 1


def test_groups_are_carried_through_windows(spark):
    df = spark.createDataFrame([("a", "Black women lead the board of the town now. Nobody said anything about it then. A third sentence follows here. And a fourth one too."), ("b", "Management is all there is to be read here."), ("c", None)], "article_id string, content string")
    a = A.FrameAnalyzer(D.KeywordDetector(), preprocess=True, segment=True)
    got = {r["article_id"]: r["demographics"] for r in a.analyze(df.where("content is not null")).collect()}
    assert got == {"a": ["black", "women", "women_of_color"], "b": ["men"]}
    assert "Join" not in a.unit_results(df)._jdf.queryExecution().executedPlan().toString()


def test_agreement_in_one_pass(spark):
    flags = spark.createDataFrame([("a", "obstacles", True, True), ("a", "successes", False, True), ("b", "obstacles", True, False), ("b", "successes", False, False)], "article_id string, frame string, human boolean, ml boolean")
    got = {r["metric"]: r["value"] for r in V.agreement_metrics(flags).collect()}
    assert got["obstacles_precision"] == 1.0 and got["obstacles_recall"] == 0.5 and got["overall_accuracy"] == 0.5 and got["overall_f1"] == 0.5 and len(got) == 12
    assert V.agreement_metrics(flags)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_only_a_missing_subpackage_is_forgiven(monkeypatch):
    entry = importlib.import_module("__spark_entry__")
    monkeypatch.setitem(sys.modules, "framelens.llm", None)
    monkeypatch.delitem(sys.modules, "framelens.llm.oracles", raising=False)
    monkeypatch.delitem(sys.modules, "framelens.llm.queries", raising=False)
    assert "p1_found" in importlib.reload(entry).queries()
    monkeypatch.undo()
    importlib.reload(entry)


def test_repeated_measures_against_its_definition(spark):
    x = {"a": (3, 1, 2), "b": (5, 2, 2), "c": (4, 0, 3), "d": (0, 0, 0)}
    rows = [(k, "obstacles", g, float(v), 7) for k, vs in x.items() for g, v in zip(("u", "v", "w"), vs) if v] + [("d", "obstacles", "other", 9.0, 7), ("a", "successes", "u", None, 7), (None, "obstacles", "u", 5.0, 7), ("a", None, "u", 5.0, 7)]
    df = spark.createDataFrame(rows, "article_id string, frame_type string, demographic_group string, count double, n int")
    got = {r["frame_type"]: r for r in V.repeated_measures(df, ("u", "v", "w")).collect()}
    m = [list(v) for v in x.values()]
    grand = sum(map(sum, m)) / 12
    cond = sum(4 * (sum(r[j] for r in m) / 4 - grand) ** 2 for j in range(3))
    subj = sum(3 * (sum(r) / 3 - grand) ** 2 for r in m)
    err = sum((v - grand) ** 2 for r in m for v in r) - cond - subj
    r = got["obstacles"]
    assert (r["n"], r["k"], r["df_conditions"], r["df_error"]) == (4, 3, 2, 6)
    assert abs(r["ss_conditions"] - cond) < 1e-9 and abs(r["ss_subjects"] - subj) < 1e-9 and abs(r["ss_error"] - err) < 1e-9
    assert abs(r["f"] - (cond / 2) / (err / 6)) < 1e-9 and abs(r["partial_eta2"] - cond / (cond + err)) < 1e-9
    assert got["successes"]["f"] is None
    assert V.repeated_measures(df.limit(0), ("u", "v")).count() == 0
