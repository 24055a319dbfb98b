"""Detectors, the analyser, agreement statistics."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from framelens import lexicons as L
from framelens.functions import features as E
from framelens.operators import analyze as A
from framelens.operators import detect as D
from framelens.operators import evaluate as V

TEXT = "Women hold only 21% of leadership positions, facing significant barriers to advancement."


def predict(spark, detector, text=TEXT):
    return D.detect(spark.createDataFrame([(text,)], "text string"), detector).first()["prediction"]


def test_keyword_detector(spark):
    p = predict(spark, D.KeywordDetector())
    assert p["frames"] == ["obstacles", "underrepresentation"]
    assert p["scores"] == {"underrepresentation": 0.8, "obstacles": 0.9, "overrepresentation": 0.1, "successes": 0.1}
    d = D.KeywordDetector()
    d.set_threshold(0.85)
    assert predict(spark, d)["frames"] == ["obstacles"]
    assert predict(spark, D.KeywordDetector(), None)["frames"] == []


def test_ensemble(spark):
    p = predict(spark, D.EnsembleDetector([D.KeywordDetector(), D.LexiconDetector()], [0.5, 0.5]))
    assert p["scores"]["obstacles"] == pytest.approx(0.45)  # 'barriers' isn't the lexicon's 'barrier'
    assert predict(spark, D.EnsembleDetector([D.KeywordDetector()] * 2))["scores"]["obstacles"] == pytest.approx(0.9)
    for weights in ([1.0], [0.5, 0.6]):
        with pytest.raises(ValueError):
            D.EnsembleDetector([D.KeywordDetector(), D.LexiconDetector()], weights)


def test_ensemble_counts_missing_frames_as_zero(spark):
    df = spark.createDataFrame([({"a": 1.0, "b": 0.5}, {"a": 0.5, "c": 1.0})], "x map<string,double>, y map<string,double>")
    assert df.select(D.combine([F.col("x"), F.col("y")], [0.5, 0.5]).alias("s")).first()["s"] == {"a": 0.75, "b": 0.25}


def test_model_detector_batches(spark):
    def load():
        def run(texts):
            assert len(texts) <= 3
            return [{f: float(len(t)) for f in L.FRAMES} for t in texts]

        return run

    df = spark.createDataFrame([("x" * i,) for i in range(10)] + [(None,)], "text string").repartition(1)
    got = sorted(r["prediction"]["scores"]["successes"] for r in D.detect(df, D.ModelDetector(load, max_batch=3)).collect())
    assert got == [0.0, 0.0, *map(float, range(1, 10))]


def test_trained_detector(spark):
    rows = [(i, "the first woman appointed, a milestone", ["successes"]) if i % 2 else (i, "a barrier, a ceiling and bias", ["obstacles"]) for i in range(40)]
    v = E.feature_vectors(spark.createDataFrame(rows, "id int, text string, labels array<string>"), labels="labels")
    scored = D.logistic_scores(v, D.train_logistic(v)).collect()
    assert all((r["scores"]["successes"] > 0.5) == (r["id"] % 2 == 1) for r in scored)


def test_confidence_bins(spark):
    df = spark.createDataFrame([(0.4,), (0.5,), (0.75,), (0.95,), (None,)], "s double")
    assert [r["b"] for r in df.select(D.confidence_bin(F.col("s")).alias("b")).collect()] == [0, 1, 2, 3, None]


def test_analyzer(spark):
    content = "Women hold only few posts. " * 4 + "There is a barrier for all men here. It is a challenge for managers too."
    df = spark.createDataFrame([("a", content), ("b", "")], "article_id string, content string")
    r = {x["article_id"]: x for x in A.FrameAnalyzer(D.KeywordDetector(), segment=True).analyze(df).collect()}
    a = r["a"]
    assert a["segments_analyzed"] == 3 and a["frames_detected"] == ["obstacles", "underrepresentation"]
    assert a["frame_counts"]["frames"] == {"underrepresentation": 2, "obstacles": 2}
    assert a["frame_scores"]["underrepresentation"] == pytest.approx((0.8 + 0.8 + 0.2) / 3)
    assert len(a["detailed_results"]) == 3 and r["b"]["detailed_results"] is None and r["b"]["segments_analyzed"] == 1
    s = A.FrameAnalyzer(D.KeywordDetector(), preprocess=True).analyze(df).where("article_id = 'a'").first()
    assert s["demographics"] == ["men", "women"] and s["segments_analyzed"] == 1
    assert {x["frame"] for x in A.FrameAnalyzer(D.KeywordDetector()).summary(df).collect()} == set(L.FRAMES)


def test_segment_metadata(spark):
    df = spark.createDataFrame([("a", "x", "One long sentence here. Another long sentence here."), ("b", None, "")], "article_id string, cleaned_content string, content string")
    m = {r["article_id"]: r["metadata"] for r in A.segment_for_analysis(df).collect()}
    assert m["a"]["total_sentences"] == 0  # the cleaned text goes first
    m = {r["article_id"]: r["metadata"] for r in A.segment_for_analysis(df.drop("cleaned_content")).collect()}
    assert (m["a"]["total_sentences"], m["a"]["avg_sentence_length"], m["b"]["avg_sentence_length"], m["b"]["total_windows"]) == (2, 4.0, 0.0, 1)


def test_icc(spark):
    df = spark.createDataFrame(list(zip([1, 0, 1, 1, 0, None], [1, 0, 1, 0, 0, 1])), "a int, b int")
    r = V.icc(df, "a", "b").first()
    assert r["n"] == 5 and r["icc_ref"] == pytest.approx(0.904762, abs=1e-6)
    assert V.icc(df.limit(0), "a", "b").first()["icc_ref"] is None
    assert V.icc(spark.createDataFrame([(1, 1), (1, 1)], "a int, b int"), "a", "b").first()["icc_ref"] is None


def test_icc_2_1_of_the_textbook(spark):
    r = random.Random(1)
    a = [r.randint(0, 5) for _ in range(30)]
    b = [x + r.randint(-1, 2) for x in a]
    n, grand = 30, (sum(a) + sum(b)) / 60
    rows = [(x + y) / 2 for x, y in zip(a, b)]
    cols = [sum(a) / n, sum(b) / n]
    msr = 2 * sum((m - grand) ** 2 for m in rows) / (n - 1)
    msc = n * sum((c - grand) ** 2 for c in cols)
    mse = sum((v - rows[i] - cols[k] + grand) ** 2 for k, xs in enumerate((a, b)) for i, v in enumerate(xs)) / (n - 1)
    want = (msr - mse) / (msr + mse + 2 * (msc - mse) / n)
    assert V.icc(spark.createDataFrame(list(zip(a, b)), "a int, b int"), "a", "b").first()["icc_2_1"] == pytest.approx(want)


def test_agreement(spark):
    r = random.Random(2)
    rows = [(str(i), [f for f in L.FRAMES[:3] if r.random() < 0.5], [f for f in L.FRAMES[:3] if r.random() < 0.5]) for i in range(40)] + [("x", None, None)]
    flags = V.frame_flags(spark.createDataFrame(rows, "article_id string, h array<string>, p array<string>"), F.col("h"), F.col("p"))
    got = {x["metric"]: x["value"] for x in V.agreement_metrics(flags).collect()}
    assert len(got) == 20
    for f in L.FRAMES:
        pairs = [(f in (h or []), f in (p or [])) for _, h, p in rows]
        tp, fp, fn = (sum(x == y for x in pairs) for y in ((True, True), (False, True), (True, False)))
        assert got[f"{f}_precision"] == pytest.approx(tp / (tp + fp) if tp + fp else 0)
        assert got[f"{f}_recall"] == pytest.approx(tp / (tp + fn) if tp + fn else 0)
    assert got["successes_kappa"] is None and got["successes_f1"] == 0  # nobody found it: chance agreement is whole
    assert 0 < got["overall_accuracy"] < 1
    acc = {x["frame"]: x["accuracy"] for x in V.match_accuracy(flags).collect()}
    assert acc[None] == pytest.approx(got["overall_accuracy"]) and acc["successes"] == 1


def test_merge(spark):
    a = spark.createDataFrame([("1", "x", 5), ("2", "y", 6)], "article_id string, frames string, n int")
    p = spark.createDataFrame([("1", "z"), ("1", "w"), ("3", "v")], "article_id string, frames string")
    m = V.merge_with_predictions(a, p)
    assert set(m.columns) == {"article_id", "frames_human", "frames_predicted", "n"} and m.count() == 2
