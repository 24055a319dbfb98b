"""Shredding: levels of the published example, a round trip of random records, and the coding tables."""

from __future__ import annotations

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from framelens.operators import coding_tables as C
from framelens.operators import shred as S

# the example of the paper on columnar storage of nested records
DOCUMENT = S.Struct({"links": S.Struct({"backward": S.List(S.Leaf()), "forward": S.List(S.Leaf())}), "name": S.List(S.Struct({"language": S.List(S.Struct({"code": S.Leaf(), "country": S.Leaf()})), "url": S.Leaf()}))})
RECORD = {"links": {"forward": [20, 40, 60]}, "name": [{"language": [{"code": "en-us", "country": "us"}, {"code": "en"}], "url": "A"}, {"url": "B"}, {"language": [{"code": "en-gb", "country": "gb"}]}]}


def test_levels():
    c = S.shred(DOCUMENT, RECORD)
    code = c["name", "[]", "language", "[]", "code"]
    assert code.rep == [0, 2, 1, 1] and code.values == ["en-us", "en", None, "en-gb"]
    assert code.defs[0] == code.defs[1] == code.defs[3] > code.defs[2]
    assert c["links", "forward", "[]"].rep == [0, 1, 1]
    assert c["links", "backward", "[]"].values == [None]


def test_tables_keep_their_parents():
    c = S.shred(DOCUMENT, RECORD)
    names = S.table(DOCUMENT, c, ("name", "[]"))
    assert [(r["ordinals"], r["url"]) for r in names] == [((0,), "A"), ((1,), "B"), ((2,), None)]
    langs = S.table(DOCUMENT, c, ("name", "[]", "language", "[]"))
    assert [(r["ordinals"], r["code"], r["country"]) for r in langs] == [((0, 0), "en-us", "us"), ((0, 1), "en", None), ((2, 0), "en-gb", "gb")]


exemplar = st.fixed_dictionaries({}, optional={"sentence": st.integers(0, 99), "coder": st.text(max_size=3), "tags": st.lists(st.text(max_size=2), max_size=2)})
cell = st.fixed_dictionaries({"count": st.none() | st.integers(0, 9), "exemplars": st.none() | st.lists(exemplar, max_size=3)})
coding = st.dictionaries(st.sampled_from(C.FRAMES), st.dictionaries(st.sampled_from("abc"), cell, max_size=3), max_size=3)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.fixed_dictionaries({"article_id": st.none() | st.text(max_size=3), "coding": coding}), max_size=4))
def test_tables_hold_exactly_what_the_record_held(articles):
    columns = S.shred(C.RECORD, {"articles": articles})
    cells = {(r["ordinals"][0], *r["keys"]): r.get("count") for r in S.table(C.RECORD, columns, C.CELLS)}
    assert cells == {(i, f, g): x["count"] for i, a in enumerate(articles) for f, gs in a["coding"].items() for g, x in gs.items()}
    found = [(r["ordinals"][0], *r["keys"], r["ordinals"][3], r.get("sentence"), r.get("coder")) for r in S.table(C.RECORD, columns, C.EXEMPLARS)]
    assert found == [(i, f, g, k, e.get("sentence"), e.get("coder")) for i, a in enumerate(articles) for f, gs in a["coding"].items() for g, x in gs.items() for k, e in enumerate(x["exemplars"] or [])]
    tags = [(r["ordinals"], r[""]) for r in S.table(C.RECORD, columns, (*C.EXEMPLARS, "tags", "[]"))]
    assert [v for _, v in tags] == [t for a in articles for gs in a["coding"].values() for x in gs.values() for e in x["exemplars"] or [] for t in e.get("tags", [])]


def test_every_shape_of_a_delivery(spark):
    ex = [{"sentence": 3}, {"sentence": 4, "review": {"by": "c1", "marks": [{"agree": None}]}}]
    shapes = {
        "list": {"sample_articles": [{"article_id": "x", "human_coding": {"obstacles": {"women": ex, "men": 2, "poc": None, "w": [], "v": "", "u": {}}}}, None, {"article_id": "y"}]},
        "alone": {"sample_articles": {"article_id": "x", "human_coding": {"successes": {"men": "3"}, "version": 2, "coder_note": "see"}}},
        "nested": {"payload": {"sample_articles": [{}, {"human_coding": [{"frame": "obstacles", "groups": [{"group": "men", "exemplars": ex, "count": 9}, {"group": "women", "exemplars": []}, {"group": "poc", "count": 1, "exemplars": None}]}]}]}},
        "string": {"sample_articles": [{"human_coding": json.dumps({"obstacles": {"women": {"count": 0}}})}]},
        "none": {"sample_articles": None},
    }
    rows = [(k, json.dumps(v)) for k, v in shapes.items()] * 2 + [("cut", json.dumps(shapes["list"])[:-9]), ("null", None), ("empty", ""), (None, json.dumps(shapes["list"])), ("number", "7")]
    deliveries = spark.createDataFrame(rows, "delivery_id string, payload string").withColumn("part", __import__("pyspark").sql.functions.lit(1))
    got = sorted(tuple(r) for r in C.coded_units(C.shredded_deliveries(deliveries)).collect())
    assert got == sorted(
        [("list", 0, "obstacles", "women", 0), ("list", 0, "obstacles", "women", 1), ("list", 0, "obstacles", "men", -1), ("alone", 0, "successes", "men", -1), ("nested", 1, "obstacles", "men", 0), ("nested", 1, "obstacles", "men", 1), ("nested", 1, "obstacles", "poc", -1), ("string", 0, "obstacles", "women", -1)]
    )
    a = C.article_table(C.shredded_deliveries(deliveries))
    assert a.where("record_id = 'list'").count() == 3


def test_tags_marks_and_repeated_cells(spark):
    ex = [{"sentence": 1, "tags": ["a", None, "b"]}, {"sentence": 2, "tags": [], "review": {"by": "c", "marks": [{"agree": True}, {"agree": None}]}}]
    named = [{"group": "men", "exemplars": ex, "count": 2}, {"group": "men", "exemplars": [{"sentence": 3, "tags": ["c"]}], "count": 1}, {"group": "men", "exemplars": ex, "count": 2}]
    payload = json.dumps({"sample_articles": [None, {"human_coding": [{"frame": "obstacles", "groups": named}]}]})
    rows = C.shredded_deliveries(spark.createDataFrame([("d", payload)], "delivery_id string, payload string")).cache()
    at = ("d", 1, "obstacles", "men")
    assert sorted(map(tuple, C.tag_table(rows).collect()), key=str) == sorted([(*at, 0, 0, "a"), (*at, 0, 1, None), (*at, 0, 2, "b"), (*at, 2, 0, "c")], key=str)
    assert sorted(map(tuple, C.mark_table(rows).collect()), key=str) == sorted([(*at, 1, 0, True), (*at, 1, 1, None)], key=str)
    assert [tuple(r) for r in C.cell_table(rows).collect()] == [(*at, 3.0, 3)]
    assert sorted(r["sentence"] for r in C.exemplar_table(rows).collect()) == [1, 2, 3]


def test_articles_and_empty_tables(spark):
    schema = "article_id string, source string, human_coding map<string,map<string,double>>, extra int"
    a = spark.createDataFrame([("a", "s", {"obstacles": {"men": 1.0, "women": None}, "other": {"men": 1.0}, "successes": None}, 1), ("a", "s", {"obstacles": {"men": 1.0}}, 1), ("b", None, None, 2), (None, "s", {"obstacles": {"men": 1.0}}, 3), ("c", "s", {"obstacles": {"men": float("nan")}}, 3)], schema)
    assert [tuple(r) for r in C.coded_units(C.shredded_articles(a)).collect()] == [("a", 0, "obstacles", "men", -1)]
    assert C.article_table(C.shredded_articles(a)).count() == 3
    d = spark.createDataFrame([], "delivery_id string, payload string")
    assert C.coded_units(C.shredded(a.limit(0), d)).count() == 0
    assert C.exemplar_table(C.shredded(a, d)).count() == 0 and C.cell_table(C.shredded(a, d)).count() >= 1


def test_null_exemplars_keep_the_places_of_others(spark):
    payloads = [
        ("d1", '{"sample_articles": [{"article_id": "a", "human_coding": {"obstacles": {"women": [null, {"quote": "b"}, "c"]}}}]}'),
        ("d2", '{"sample_articles": [{"article_id": "a", "human_coding": {"obstacles": {"women": {"count": 2, "exemplars": [null]}, "men": [null]}}}]}'),
    ]
    rows = C.shredded_deliveries(spark.createDataFrame(payloads, "delivery_id string, payload string"))
    assert {(r["record_id"], r["demographic_group"], r["exemplar_no"]) for r in C.coded_units(rows).collect()} == {("d1", "women", 1), ("d1", "women", 2), ("d2", "women", -1)}
    assert {(r["exemplar_no"], r["quote"]) for r in C.exemplar_table(rows).collect()} == {(1, "b"), (2, "c")}
    assert {(r["demographic_group"], r["count"], r["n_exemplars"]) for r in C.cell_table(rows).where("record_id = 'd2'").collect()} == {("women", 2.0, 0), ("men", None, 0)}
