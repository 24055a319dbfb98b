"""Articles as a table: reading, writing, facts, validation, splits."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from framelens.operators import corpus as C
from framelens.operators import evaluate as V
from framelens.sources import articles as S

ARTICLES = [
    {"article_id": "a1", "source": "Echo", "date": "2020-01-01", "title": "One", "content": "The CEO said only few women lead. " * 3, "url": None, "human_coding": {"obstacles": {"women": 2.0}, "successes": {}}},
    {"article_id": "a2", "source": "Ledger", "date": "2020-02-01", "title": "Two", "content": "Short.", "url": "u", "human_coding": None},
    {"article_id": "a3", "source": "Echo", "date": "2019-05-05", "title": None, "content": None, "url": None, "human_coding": {"underrepresentation": {"women": 1.0, "men_of_color": 1.5}}},
]


@pytest.fixture
def articles(spark, tmp_path):
    (tmp_path / "articles.json").write_text(json.dumps(ARTICLES))
    return S.read_json(spark, str(tmp_path / "articles.json"))


def test_reading_and_filters(spark, articles, tmp_path):
    rows = {r["article_id"]: r for r in C.load_articles(articles).collect()}
    assert (rows["a2"]["content_length"], rows["a2"]["word_count"]) == (6, 1)
    assert rows["a3"]["content_length"] is None and rows["a3"]["word_count"] is None
    assert C.load_articles(articles, "Echo").count() == 2
    assert S.read_articles(spark, str(tmp_path / "articles.json"), "Ledger").count() == 1
    with pytest.raises(FileNotFoundError):
        S.read_json(spark, str(tmp_path / "none.json"))
    assert S.missing_fields(articles) == [] and S.missing_fields(articles.drop("date")) == ["date"]


@pytest.mark.parametrize("format", ["parquet", "csv", "json", "pickle"])
def test_writing_and_reading_back(spark, articles, tmp_path, format):
    path = str(tmp_path / f"out.{ {'pickle': 'parquet', 'json': 'jsonl'}.get(format, format) }")
    S.write(articles, path, format)
    back = {r["article_id"]: r for r in S.read_articles(spark, path).collect()}
    assert back["a1"]["human_coding"] == ARTICLES[0]["human_coding"] and back["a1"]["content"] == ARTICLES[0]["content"]
    assert back["a2"]["human_coding"] is None


def test_unknown_formats(spark, articles, tmp_path):
    for f in (lambda: S.write(articles, str(tmp_path / "x"), "excel"), lambda: S.save_results({}, str(tmp_path / "x"), "excel")):
        with pytest.raises(ValueError):
            f()
    S.save_results({"a": 1}, str(tmp_path / "deep" / "r.json"))
    assert json.loads((tmp_path / "deep" / "r.json").read_text()) == {"a": 1}


def test_cache(spark, articles, tmp_path):
    cache = S.Cache(spark, str(tmp_path / "cache"))
    assert cache.load("p") is None
    cache.save(articles, "p")
    assert cache.load("p").count() == 3 and cache.load("p", "v2") is None
    cache.clear()
    assert cache.load("p") is None


def test_latest_row(spark):
    df = spark.createDataFrame([("a", "x", 1, {"k": 1.0}), ("a", "y", 2, None), ("b", None, 1, None), (None, "z", 1, None)], "article_id string, content string, ingested_at int, m map<string,double>")
    assert {r["article_id"]: r["content"] for r in C.latest(df).collect()} == {"a": "y", "b": None}


def test_facts_and_validation(articles):
    assert C.coding_facts(articles).count() == 3
    parsed = {r["article_id"]: r["c"] for r in articles.select("article_id", C.parse_coding(F.col("human_coding")).alias("c")).collect()}
    assert parsed["a2"] == {"underrepresentation": {}, "overrepresentation": {}, "obstacles": {}, "successes": {}}
    r = V.frame_summary(C.coding_facts(articles)).collect()
    assert [(x["frame"], x["demographic"], x["total_count"], x["num_articles"]) for x in r] == [("underrepresentation", "women", 1.0, 1), ("underrepresentation", "men_of_color", 1.5, 1), ("obstacles", "women", 2.0, 1)]
    v = C.validation_summary(articles).first()
    assert (v["total_articles"], v["missing_content"], v["total_annotations"], v["uncoded_articles"], v["missing_coding"], v["n_issues"], v["is_valid"]) == (3, 1, 3, 1, 0, 3, False)
    assert {(i["article_id"], i["issue"][:2]) for i in C.issues(articles).collect()} == {("a2", "co"), ("a2", "no"), ("a3", "co")}
    empty = C.validation_summary(articles.limit(0)).first()
    assert (empty["total_articles"], empty["is_valid"]) == (0, True)


@pytest.mark.parametrize(("n", "sizes"), [(5, (3, 1, 1)), (10, (6, 2, 2)), (100, (64, 16, 20)), (462, (295, 74, 93)), (0, (0, 0, 0))])
def test_split_sizes(spark, n, sizes):
    assert C.split_sizes(n) == sizes
    df = spark.range(n).select(F.col("id").cast("string").alias("article_id"), F.lit("x").alias("split"))
    got = {r["split"]: r["n"] for r in C.train_val_test(df).groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == sizes


def test_split_of_total():
    assert C.split_sizes(100, of_total=True) == (60, 20, 20)


def test_ranked_split_is_one_order(spark, monkeypatch):
    monkeypatch.setattr(C, "RANGE_ROWS", 3)
    df = spark.range(400).select(F.concat(F.lit("art"), "id").alias("article_id"))
    whole = {r["article_id"]: r["split"] for r in C.train_val_test(df).collect()}
    by_one = {r["article_id"]: r["split"] for r in C.train_val_test(df.withColumn("g", F.lit(None).cast("int")), by="g").collect()}
    monkeypatch.setattr(C, "RANGE_ROWS", 10**9)
    one_range = {r["article_id"]: r["split"] for r in C.train_val_test(df).collect()}
    assert whole == by_one == one_range and len(whole) == 400


def test_training_examples_and_exemplars(articles):
    t = C.training_examples(articles).collect()
    assert [(r["article_id"], r["demographics"], r["labels"]) for r in t] == [("a1", ["women"], ["obstacles"])]
    e = {(r["article_id"], r["frame_type"], r["demographic_group"]): r["exemplars"] for r in C.exemplars(articles).collect()}
    assert e == {("a1", "underrepresentation", "women"): 3}


def test_preprocess_keeps_everything(articles):
    p = {r["article_id"]: r for r in C.preprocess(articles).collect()}
    assert p["a1"]["sentence_count"] == 3 and len(p["a1"]["paragraphs"]) == 1 and p["a1"]["human_coding"]
    assert p["a3"]["cleaned_content"] is None


def test_sources(spark, articles):
    mapping = spark.createDataFrame([("ECHO ", "The Echo"), ("echo", "The Echo"), (None, "x")], "variant string, source string")
    assert {r["canonical_source"] for r in C.normalised_source(articles, mapping).collect()} == {"The Echo", "Ledger"}


def test_batches_and_folds(spark):
    df = spark.createDataFrame([("s", i) for i in range(7)], "g string, i int")
    assert sorted(r["batch"] for r in C.batches(df, 3, "i", "g").collect()) == [0, 0, 0, 1, 1, 1, 2]
    assert {r["fold"] for r in C.folds(spark.range(200).withColumnRenamed("id", "article_id")).collect()} == {0, 1, 2, 3, 4}


def test_latest_rows(spark, tmp_path):
    """Null and tied orders, equal rows, null keys; the same from files and from other tables where the order decides."""
    rows = [("a", 1, "old"), ("a", 2, "new"), ("b", None, "only"), ("c", None, "null"), ("c", 1, "x"), ("d", 3, "t"), ("d", 3, "t"), ("e", 4, "one"), ("e", 4, "two"), ("f", 5, None), (None, 1, "n")]
    df = spark.createDataFrame(rows, "article_id string, ingested_at int, content string")
    df.repartition(3).write.parquet(str(tmp_path / "t"))
    for t in (df, spark.read.parquet(str(tmp_path / "t"))):
        got = {r["article_id"]: r["content"] for r in C.latest(t).collect()}
        assert len(C.latest(t).collect()) == 6 and got.pop("e") in ("one", "two")
        assert got == {"a": "new", "b": "only", "c": "x", "d": "t", "f": None}
    assert C.latest(spark.read.parquet(str(tmp_path / "t")).limit(0)).count() == 0


def test_latest_rows_beyond_what_is_sent(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(f"k{i % 700}", i, f"text {i}") for i in range(10_000)], "article_id string, ingested_at int, content string")
    df.coalesce(1).write.parquet(str(tmp_path / "t"))
    want = {(f"k{i}", f"text {max(range(i, 10_000, 700))}") for i in range(700)}
    for most in (8_000_000, 5):
        monkeypatch.setattr(C, "LOST_ROWS", most)
        got = C.latest(spark.read.parquet(str(tmp_path / "t"))).select("article_id", "content").collect()
        assert {tuple(r) for r in got} == want and len(got) == 700


def test_latest_moves_no_text(spark, tmp_path):
    spark.createDataFrame([("a", 1, "x y", "s"), ("a", 2, "y z", "s")], "article_id string, ingested_at int, content string, source string").write.parquet(str(tmp_path / "sample_articles.parquet"))
    from framelens.plans.analysis import QUERIES

    df = QUERIES["clean_text_stats"](spark, str(tmp_path))
    assert df.count() == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if ("Exchange" in line or "Sort" in line) and "content" in line]
    assert not moved and "BroadcastHashJoin" in plan


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from framelens import session

    conf = SimpleNamespace(get=lambda *_: None)
    for master, fails in (("spark://h:7077", True), ("local-cluster[3,2,1024]", True), ("yarn", True), ("local[2]", False)):
        fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None, set=lambda *_: None), sparkContext=SimpleNamespace(getConf=lambda: conf, master=master))
        if fails:
            with pytest.raises(ValueError):
                session.shared_dir(fake)
        else:
            assert session.shared_dir(fake).startswith("file:///")


def test_what_was_settled_is_settled_anew_when_files_change(spark, tmp_path):
    path = str(tmp_path / "a b.parquet")
    write = lambda rows: spark.createDataFrame(rows, "article_id string, ingested_at int, content string").coalesce(1).write.mode("overwrite").parquet(path)
    read = lambda **w: {tuple(r) for r in C.latest(spark.read.parquet(path), **w).select("article_id", "content").collect()}
    write([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")])
    assert read() == read() == {("a", "y"), ("b", "z")}
    assert {tuple(r) for r in C.latest(spark.read.parquet(path).where("content <> 'y'")).select("article_id", "content").collect()} == {("a", "x"), ("b", "z")}
    write([("a", 3, "x"), ("a", 2, "y"), ("b", 1, "z"), ("b", 2, "w")])
    assert read() == {("a", "x"), ("b", "w")}
