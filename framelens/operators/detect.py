"""Frame detectors: text in, struct<frames, scores> out. A detector is anything with ``scores(text) -> Column`` of
map<frame, score>, or ``score_frame`` for models that run in Python workers.

Detectors of plain expressions stay in the JVM. Model-backed ones load the model once a worker and get batches by Arrow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens import lexicons as L
from framelens.functions.text import bound

SCORES = "map<string,double>"


class Detector(Protocol):
    threshold: float

    def scores(self, text: Column) -> Column: ...


def frames_from(scores: Column, threshold: float = 0.5, strict: bool = False) -> Column:
    """Frames at or above the threshold (above it if strict), sorted."""
    return F.array_sort(F.map_keys(F.map_filter(scores, lambda _, v: (v > threshold) if strict else (v >= threshold))))


def detect(df: DataFrame, detector: Detector, text: str = "text", out: str = "prediction") -> DataFrame:
    """df with ``prediction``: struct<frames: array<string>, scores: map<string,double>>."""
    scored = df.withColumn("_scores", detector.scores(F.col(text)))
    return scored.withColumn(out, F.struct(frames_from(F.col("_scores"), detector.threshold).alias("frames"), F.col("_scores").alias("scores"))).drop("_scores")


class KeywordDetector:
    """Scores by substrings: of the first list present the high score, else the low one."""

    #: frame -> (substrings, score if one is there, score if none is)
    RULES: dict[str, tuple[tuple[str, ...], float, float]] = {
        "underrepresentation": (("only", "just"), 0.8, 0.2),
        "obstacles": (("barrier", "challenge"), 0.9, 0.1),
        "overrepresentation": ((), 0.1, 0.1),
        "successes": ((), 0.1, 0.1),
    }

    def __init__(self, threshold: float = 0.5, rules: dict | None = None):
        self.threshold, self.rules = threshold, rules or self.RULES

    def set_threshold(self, threshold: float) -> None:
        self.threshold = threshold

    def scores(self, text: Column) -> Column:
        low = F.lower(text)
        entries: list[Column] = []
        for frame, (terms, high, rest) in self.rules.items():
            any_ = F.lit(False)
            for t in terms:
                any_ = any_ | low.contains(t)
            entries += [F.lit(frame), F.when(any_, F.lit(high)).otherwise(F.lit(rest))]
        return F.create_map(*entries)


class LexiconDetector:
    """Scores by the frames' lexicons: 1 - 1 / (1 + weighted hits). An untrained stand-in that needs no model."""

    def __init__(self, threshold: float = 0.5):
        self.threshold = threshold

    def set_threshold(self, threshold: float) -> None:
        self.threshold = threshold

    def scores(self, text: Column) -> Column:
        from framelens.functions import features as E

        def score(found: Column) -> Column:
            total = E.lexical_features(found, F.lit(1))
            return F.create_map(*(x for f in L.FRAMES for x in (F.lit(f), 1.0 - 1.0 / (1.0 + total[f"{f}_total_score"]))))

        return bound(E.found_terms(text), score)


class EnsembleDetector:
    """Weighted mean of detectors' scores; the frames are the first one's, and a frame that another lacks counts as 0."""

    def __init__(self, detectors: list[Detector], weights: list[float] | None = None, threshold: float = 0.5):
        weights = [1.0 / len(detectors)] * len(detectors) if weights is None else list(weights)
        if len(weights) != len(detectors) or abs(sum(weights) - 1.0) >= 1e-6:
            raise ValueError("one weight a detector is needed, and they must sum to 1")
        self.detectors, self.weights, self.threshold = detectors, weights, threshold

    def set_threshold(self, threshold: float) -> None:
        self.threshold = threshold

    def scores(self, text: Column) -> Column:
        return combine([d.scores(text) for d in self.detectors], self.weights)


def combine(scores: list[Column], weights: list[float]) -> Column:
    """Weighted sum of score maps over the frames of the first."""
    out = F.transform_values(scores[0], lambda _, v: v * F.lit(weights[0]))
    for s, w in zip(scores[1:], weights[1:]):
        out = _plus(out, s, w)
    return out


def _plus(total: Column, scores: Column, weight: float) -> Column:
    return F.transform_values(total, lambda k, v: v + F.coalesce(F.try_element_at(scores, k), F.lit(0.0)) * F.lit(weight))


class ModelDetector:
    """A model in Python workers. ``load`` is called once a worker and gives a function from a list of texts to a list of
    dicts frame -> score. ``max_batch`` texts go to the model at once."""

    def __init__(self, load: Callable[[], Callable[[list[str]], list[dict[str, float]]]], threshold: float = 0.5, max_batch: int = 32):
        self.load, self.threshold, self.max_batch = load, threshold, max_batch

    def set_threshold(self, threshold: float) -> None:
        self.threshold = threshold

    def scores(self, text: Column) -> Column:
        load, size = self.load, self.max_batch

        @F.pandas_udf(SCORES)
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                out: list[dict[str, float] | None] = []
                known = [t or "" for t in texts]
                for i in range(0, len(known), size):
                    out += model(known[i : i + size])
                yield pd.Series(out, dtype=object)

        return score(text)


def zero_shot(model_name: str = "facebook/bart-large-mnli", device: int = -1, threshold: float = 0.5) -> ModelDetector:
    """A zero-shot classifier by natural-language inference; needs the transformers library on the workers."""
    labels = L.ZERO_SHOT_LABELS

    def load():
        from transformers import pipeline

        classify = pipeline("zero-shot-classification", model=model_name, device=device)
        name_of = {v: k for k, v in labels.items()}

        def run(texts: list[str]) -> list[dict[str, float]]:
            found = classify(texts, candidate_labels=list(labels.values()), multi_label=True)
            return [{name_of[x]: float(s) for x, s in zip(r["labels"], r["scores"])} for r in found]

        return run

    return ModelDetector(load, threshold, max_batch=8)


def fine_tuned(model_path: str, device: str = "cpu", threshold: float = 0.5, max_tokens: int = 512) -> ModelDetector:
    """A fine-tuned classifier with one logit a frame; needs torch and transformers on the workers."""

    def load():
        import torch
        from transformers import AutoModelForSequenceClassification, AutoTokenizer

        tokenizer = AutoTokenizer.from_pretrained(model_path)
        model = AutoModelForSequenceClassification.from_pretrained(model_path).to(device).eval()

        def run(texts: list[str]) -> list[dict[str, float]]:
            with torch.no_grad():
                inputs = tokenizer(texts, padding=True, truncation=True, max_length=max_tokens, return_tensors="pt").to(device)
                probabilities = torch.sigmoid(model(**inputs).logits).cpu().numpy()
            return [{f: float(p) for f, p in zip(L.FRAMES, row)} for row in probabilities]

        return run

    return ModelDetector(load, threshold)


def train_logistic(examples: DataFrame, label_vector: str = "label_vector", features: str = "features", **params):
    """A logistic regression a frame on feature vectors; gives {frame: model} for ``logistic_scores``."""
    from pyspark.ml.classification import LogisticRegression

    out = {}
    for i, f in enumerate(L.FRAMES):
        data = examples.select(features, F.get(label_vector, F.lit(i)).cast("double").alias("label"))
        out[f] = LogisticRegression(featuresCol=features, labelCol="label", maxIter=params.get("max_iter", 20), regParam=params.get("reg", 0.01), standardization=True).fit(data)
    return out


def logistic_scores(df: DataFrame, models: dict, features: str = "features", out: str = "scores") -> DataFrame:
    """df with a map of the models' probabilities."""
    from pyspark.ml.functions import vector_to_array

    for f, m in models.items():
        m = m.copy().setProbabilityCol(f"_p_{f}").setRawPredictionCol(f"_r_{f}").setPredictionCol(f"_y_{f}")
        df = m.transform(df).drop(f"_r_{f}", f"_y_{f}")
    scores = F.create_map(*(x for f in models for x in (F.lit(f), vector_to_array(f"_p_{f}")[1])))
    return df.withColumn(out, scores).drop(*(f"_p_{f}" for f in models))


def confidence_bin(score: Column, edges: Iterable[float] = (0.5, 0.7, 0.9)) -> Column:
    """How many of the edges the score reaches; null for a null score."""
    return sum(((score >= e).cast("int") for e in edges), F.lit(0))
