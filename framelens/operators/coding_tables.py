"""Flat tables of articles, coded cells, exemplars, their tags and review marks out of nested human coding, by shredding (``shred``).

Two sources: the map column ``human_coding`` of articles, and JSON payloads that hold articles with nested coding in several
shapes. Shapes are brought to one before shredding: coding as an object, as a list of frames with groups, or as a string that
holds either; a cell as a count, as a count in a string, as a list of exemplars, or as an object with both.

Defined results: a payload that isn't whole JSON, null or without articles has no row; names are taken as written; keys other
than the four frames are not coding; NaN counts are null; rows and deliveries that repeat count once; an article that isn't an
object has an article row without an id; a null in a list of exemplars is none, but those after it keep their place; an
exemplar that isn't an object is a quote; a cell that a list names again adds its exemplars, in order, and its count to the
first, unless it is equal to one before it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from framelens.operators import shred as S
from framelens.session import ship, spread

#: The frames of the study.
FRAMES = ("underrepresentation", "overrepresentation", "obstacles", "successes")


def _number(x: Any) -> float | None:
    if isinstance(x, bool):
        return None
    try:
        v = float(x)
    except (TypeError, ValueError):
        return None
    return None if math.isnan(v) else v


def _text(x: Any) -> str | None:
    return None if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


EXEMPLAR = S.Struct(
    {
        "sentence": S.Leaf(lambda x: int(n) if (n := _number(x)) is not None and math.isfinite(n) else None),
        "coder": S.Leaf(_text),
        "quote": S.Leaf(_text),
        "tags": S.List(S.Leaf(_text)),
        "review": S.Struct({"by": S.Leaf(_text), "marks": S.List(S.Struct({"agree": S.Leaf(lambda x: x if isinstance(x, bool) else None)}))}),
    }
)
CODING = S.Map(S.Map(S.Struct({"count": S.Leaf(_number), "exemplars": S.List(EXEMPLAR)}), "demographic_group"), "frame_type")
RECORD = S.Struct({"articles": S.List(S.Struct({"article_id": S.Leaf(_text), "source": S.Leaf(_text), "coding": CODING}))})
ARTICLES = ("articles", "[]")
CELLS = (*ARTICLES, "coding", "{}", "{}")
EXEMPLARS = (*CELLS, "exemplars", "[]")
TAGS = (*EXEMPLARS, "tags", "[]")
MARKS = (*EXEMPLARS, "review", "marks", "[]")


def _listed(exemplars: list) -> list[dict[str, Any] | None]:
    return [e if e is None or isinstance(e, dict) else {"quote": e} for e in exemplars]


def one_shape_of_cell(cell: Any) -> dict[str, Any] | None:
    """{'count', 'exemplars'} of a cell in any shape; null for null and empty cells."""
    if cell is None or cell in ("", [], {}):
        return None
    if isinstance(cell, dict):
        listed = cell.get("exemplars")
        return {"count": cell.get("count"), "exemplars": _listed(listed) if isinstance(listed, list) else None}
    if isinstance(cell, list):
        return {"count": None, "exemplars": _listed(cell)}
    return {"count": cell, "exemplars": None}


def one_shape_of_coding(coding: Any) -> dict[str, dict[str, Any]]:
    """frame -> group -> cell, of the four frames only."""
    if isinstance(coding, str):
        try:
            coding = json.loads(coding)
        except ValueError:
            return {}
    pairs: list[tuple[Any, Any, Any]] = []
    if isinstance(coding, dict):
        pairs = [(f, g, c) for f, groups in coding.items() if isinstance(groups, dict) for g, c in groups.items()]
    elif isinstance(coding, list):
        for entry in coding:
            groups = entry.get("groups") if isinstance(entry, dict) else None
            if isinstance(groups, dict):
                pairs += [(entry.get("frame"), g, c) for g, c in groups.items()]
            elif isinstance(groups, list):
                pairs += [(entry.get("frame"), g.get("group"), {k: v for k, v in g.items() if k != "group"}) for g in groups if isinstance(g, dict)]
    named: dict[tuple[str, str], list[dict[str, Any]]] = {}
    for frame, group, cell in pairs:
        shaped = one_shape_of_cell(cell)
        if frame in FRAMES and group is not None and shaped is not None:
            named.setdefault((frame, group), []).append(shaped)
    out: dict[str, dict[str, Any]] = {}
    for (frame, group), shapes in named.items():
        out.setdefault(frame, {})[group] = merged(shapes)
    return out


def merged(shapes: list[dict[str, Any]]) -> dict[str, Any]:
    """One cell out of those that a coding names for a frame and group: exemplars in order, counts added up."""
    shapes = [x for i, x in enumerate(shapes) if x not in shapes[:i]]
    if len(shapes) == 1:
        return shapes[0]
    counts = [n for x in shapes if (n := _number(x["count"])) is not None]
    listed = [x["exemplars"] for x in shapes if x["exemplars"] is not None]
    return {"count": sum(counts) if counts else None, "exemplars": [e for es in listed for e in es] if listed else None}


def record_of_payload(payload: str | None) -> dict[str, Any] | None:
    """{'articles': [...]} of a delivery, or None if it isn't whole JSON."""
    try:
        found = json.loads(payload) if payload else None
    except (ValueError, RecursionError):
        return None
    while isinstance(found, dict) and "sample_articles" not in found and isinstance(found.get("payload"), dict | list):
        found = found["payload"]
    articles = found.get("sample_articles", [found] if "human_coding" in found else None) if isinstance(found, dict) else found
    if isinstance(articles, dict):
        articles = [articles]
    if not isinstance(articles, list):
        return None
    return {"articles": [{"article_id": a.get("article_id"), "source": a.get("source"), "coding": one_shape_of_coding(a.get("human_coding"))} if isinstance(a, dict) else {} for a in articles]}


ROW = "part string, record_id string, article_no bigint, article_id string, source string, frame_type string, demographic_group string, exemplar_no bigint, count double, n_exemplars bigint, sentence bigint, coder string, quote string, reviewer string, tag_no bigint, tag string, mark_no bigint, agree boolean"
_NAMES = [x.split()[0] for x in ROW.split(", ")]


def rows_of(record_id: str, record: dict[str, Any]) -> Iterator[tuple]:
    """The rows of the five tables of a record, from its level sequences."""
    columns = S.shred(RECORD, record)
    articles = {r["ordinals"]: r for r in S.table(RECORD, columns, ARTICLES)}
    for (no,), a in articles.items():
        yield ("article", record_id, no, a.get("article_id"), a.get("source"), *[None] * 13)
    counts = S.child_counts(RECORD, columns, CELLS, EXEMPLARS, nulls=False)
    for r in S.table(RECORD, columns, CELLS):
        a = articles[r["ordinals"][:1]]
        yield ("cell", record_id, r["ordinals"][0], a.get("article_id"), a.get("source"), *r["keys"], None, r.get("count"), counts.get(r["ordinals"], 0), *[None] * 8)
    for r in S.table(RECORD, columns, EXEMPLARS, nulls=False) if counts else ():
        a = articles[r["ordinals"][:1]]
        yield ("exemplar", record_id, r["ordinals"][0], a.get("article_id"), a.get("source"), *r["keys"], r["ordinals"][3], None, None, r.get("sentence"), r.get("coder"), r.get("quote"), r.get("review.by"), *[None] * 4)
    for part, path in (("tag", TAGS), ("mark", MARKS)) if counts else ():
        for r in S.table(RECORD, columns, path):
            a = articles[r["ordinals"][:1]]
            own = (r["ordinals"][4], r.get(""), None, None) if part == "tag" else (None, None, r["ordinals"][4], r.get("agree"))
            yield (part, record_id, r["ordinals"][0], a.get("article_id"), a.get("source"), *r["keys"], r["ordinals"][3], *[None] * 6, *own)


def _shredded(df: DataFrame, record: Callable[[Any], dict[str, Any] | None]) -> DataFrame:
    ship(df.sparkSession)
    struct = T.StructType.fromDDL(ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(struct)
        for b in batches:
            out: list[tuple] = []
            for rid, *values in zip(*(c.to_pylist() for c in b.columns)):
                if rid is not None and (found := record(*values)) is not None:
                    out += rows_of(rid, found)
            cols = list(zip(*out)) or [()] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return spread(df).mapInArrow(run, struct)


def shredded_articles(articles: DataFrame) -> DataFrame:
    """Rows of all tables from the map column; record_id is the article_id."""

    def record(source: str | None, coding: list | None) -> dict[str, Any]:
        nested = {f: dict(g) for f, g in coding or [] if g is not None}
        return {"articles": [{"article_id": None, "source": source, "coding": one_shape_of_coding(nested)}]}

    found = _shredded(articles.select("article_id", "source", "human_coding"), record)
    return found.withColumn("article_id", F.col("record_id"))


def shredded_deliveries(deliveries: DataFrame) -> DataFrame:
    """Rows of all tables from the payloads; record_id is the delivery_id."""
    return _shredded(deliveries.select("delivery_id", "payload"), record_of_payload)


def shredded(articles: DataFrame, deliveries: DataFrame) -> DataFrame:
    return shredded_articles(articles).unionByName(shredded_deliveries(deliveries))


def article_table(rows: DataFrame) -> DataFrame:
    return rows.where("part = 'article'").select("record_id", "article_no", "article_id", "source").distinct()


def cell_table(rows: DataFrame) -> DataFrame:
    return rows.where("part = 'cell'").select("record_id", "article_no", "frame_type", "demographic_group", "count", "n_exemplars").distinct()


def exemplar_table(rows: DataFrame) -> DataFrame:
    return rows.where("part = 'exemplar'").select("record_id", "article_no", "frame_type", "demographic_group", "exemplar_no", "sentence", "coder", "quote", "reviewer").distinct()


def tag_table(rows: DataFrame) -> DataFrame:
    return rows.where("part = 'tag'").select("record_id", "article_no", "frame_type", "demographic_group", "exemplar_no", "tag_no", "tag").distinct()


def mark_table(rows: DataFrame) -> DataFrame:
    return rows.where("part = 'mark'").select("record_id", "article_no", "frame_type", "demographic_group", "exemplar_no", "mark_no", "agree").distinct()


def coded_units(rows: DataFrame) -> DataFrame:
    """One row an exemplar, and one with exemplar_no -1 for a cell that has a count but no exemplar."""
    counted = (F.col("part") == "cell") & (F.col("n_exemplars") == 0) & F.col("count").isNotNull()
    units = rows.where((F.col("part") == "exemplar") | counted)
    return units.select("record_id", "article_no", "frame_type", "demographic_group", F.coalesce("exemplar_no", F.lit(-1)).cast("bigint").alias("exemplar_no")).distinct()
