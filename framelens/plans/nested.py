"""Queries on deeply nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.operators import coding_tables as C
from framelens.session import table


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.shredded(table(spark, sf_dir, "sample_articles"), table(spark, sf_dir, "raw_deliveries"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded units: one row an exemplar, or one with -1 for a cell with a count and no exemplar."""
    return C.coded_units(_rows(spark, sf_dir))


def p1_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.article_table(_rows(spark, sf_dir))


def p1_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cell_table(_rows(spark, sf_dir))


def p1_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exemplar_table(_rows(spark, sf_dir))


def p1_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tag_table(_rows(spark, sf_dir))


def p1_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.mark_table(_rows(spark, sf_dir)).withColumn("agree", F.col("agree").cast("string"))


QUERIES = {"p1_found": p1_found, "p1_articles": p1_articles, "p1_cells": p1_cells, "p1_exemplars": p1_exemplars, "p1_tags": p1_tags, "p1_marks": p1_marks}


def _sql() -> dict[str, str]:
    """The tables in SQL: the shapes of a coding and of a cell one by one, with JSON functions."""
    from framelens.operators.coding_tables import FRAMES

    four = ", ".join(f"'{f}'" for f in FRAMES)
    number = "TRY_CAST(CASE WHEN json_type({0}) IN ('VARCHAR', 'DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') THEN {0} ->> '$' END AS DOUBLE)"
    articles = f"""
    WITH own AS (SELECT article_id, source, e.key AS f, unnest(map_entries(e.value)) AS g FROM (SELECT article_id, source, unnest(map_entries(human_coding)) AS e FROM sample_articles) WHERE e.value IS NOT NULL AND article_id IS NOT NULL),
    d AS (SELECT DISTINCT delivery_id, payload::JSON AS j FROM raw_deliveries WHERE json_valid(payload) AND delivery_id IS NOT NULL),
    w AS (SELECT delivery_id, CASE WHEN (j -> 'sample_articles') IS NULL THEN ((j -> 'payload') -> 'sample_articles') ELSE (j -> 'sample_articles') END AS a FROM d),
    l AS (SELECT delivery_id, CASE json_type(a) WHEN 'ARRAY' THEN from_json(a, '["JSON"]') WHEN 'OBJECT' THEN [a] ELSE [] END AS a FROM w),
    t AS (SELECT delivery_id, generate_subscripts(a, 1) - 1 AS article_no, unnest(a) AS x FROM l),"""
    cells = f"""
    c AS (SELECT delivery_id, article_no, CASE WHEN json_type(h) = 'VARCHAR' THEN (h ->> '$')::JSON ELSE h END AS h FROM (SELECT delivery_id, article_no, (x -> 'human_coding') AS h FROM t)),
    o AS (SELECT delivery_id, article_no, f, (h -> f) AS g FROM (SELECT *, unnest(json_keys(h)) AS f FROM c WHERE json_type(h) = 'OBJECT')),
    cells AS (
      SELECT delivery_id, article_no, f, k, (g -> k) AS x FROM (SELECT *, unnest(json_keys(g)) AS k FROM o WHERE json_type(g) = 'OBJECT')
      UNION ALL
      SELECT delivery_id, article_no, f, (x ->> 'group'), CASE WHEN json_keys(x) = ['group'] THEN NULL ELSE x END FROM (SELECT delivery_id, article_no, (e ->> 'frame') AS f, unnest(from_json((e -> 'groups'), '["JSON"]')) AS x FROM (SELECT delivery_id, article_no, unnest(from_json(h, '["JSON"]')) AS e FROM c WHERE json_type(h) = 'ARRAY'))
    ),
    s AS (SELECT delivery_id, article_no, f, k, CASE json_type(x) WHEN 'ARRAY' THEN from_json(x, '["JSON"]') WHEN 'OBJECT' THEN coalesce(from_json((x -> 'exemplars'), '["JSON"]'), []) ELSE [] END AS e, CASE WHEN json_type(x) = 'OBJECT' THEN {number.format("(x -> 'count')")} ELSE {number.format("x")} END AS v FROM cells
          WHERE f IN ({four}) AND k IS NOT NULL AND x IS NOT NULL AND json_type(x) <> 'NULL' AND x::VARCHAR NOT IN ('""', '[]', '{{}}')),
    n AS (SELECT *, len(list_filter(e, lambda i: i IS NOT NULL AND json_type(i) <> 'NULL')) AS n FROM s),
    e AS (SELECT delivery_id, article_no, f, k, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS i FROM s),
    p AS (SELECT * FROM e WHERE x IS NOT NULL AND json_type(x) <> 'NULL')
    """
    whole = "TRY_CAST(TRY_CAST((x ->> 'sentence') AS DOUBLE) AS BIGINT)"
    ids = "delivery_id AS record_id, article_no, f AS frame_type, k AS demographic_group"
    return {
        "p1_found": f"{articles}{cells} SELECT DISTINCT article_id AS record_id, 0::BIGINT AS article_no, f AS frame_type, g.key AS demographic_group, (-1)::BIGINT AS exemplar_no FROM own WHERE f IN ({four}) AND g.value IS NOT NULL "
        "UNION SELECT delivery_id, article_no, f, k, i FROM p UNION SELECT delivery_id, article_no, f, k, -1 FROM n WHERE n = 0 AND v IS NOT NULL",
        "p1_articles": f"{articles.rstrip().rstrip(',')} SELECT DISTINCT article_id AS record_id, 0::BIGINT AS article_no, article_id, source FROM sample_articles WHERE article_id IS NOT NULL "
        "UNION SELECT delivery_id, article_no, (x ->> 'article_id'), (x ->> 'source') FROM t",
        "p1_cells": f"{articles}{cells} SELECT DISTINCT article_id AS record_id, 0::BIGINT AS article_no, f AS frame_type, g.key AS demographic_group, CASE WHEN NOT isnan(g.value) THEN g.value END AS count, 0::BIGINT AS n_exemplars FROM own WHERE f IN ({four}) AND g.value IS NOT NULL "
        f"UNION SELECT {ids}, v, n FROM n",
        "p1_exemplars": f"{articles}{cells} SELECT DISTINCT {ids}, i AS exemplar_no, {whole} AS sentence, (x ->> 'coder') AS coder, CASE WHEN json_type(x) = 'OBJECT' THEN (x ->> 'quote') ELSE (x ->> '$') END AS quote, ((x -> 'review') ->> 'by') AS reviewer FROM p",
        "p1_tags": f"{articles}{cells} SELECT DISTINCT {ids}, i AS exemplar_no, j AS tag_no, (y ->> '$') AS tag FROM (SELECT *, unnest(from_json((x -> 'tags'), '[\"JSON\"]')) AS y, generate_subscripts(from_json((x -> 'tags'), '[\"JSON\"]'), 1) - 1 AS j FROM p)",
        "p1_marks": f"{articles}{cells} SELECT DISTINCT {ids}, i AS exemplar_no, j AS mark_no, TRY_CAST((y ->> 'agree') AS BOOLEAN)::VARCHAR AS agree FROM (SELECT *, unnest(from_json(((x -> 'review') -> 'marks'), '[\"JSON\"]')) AS y, generate_subscripts(from_json(((x -> 'review') -> 'marks'), '[\"JSON\"]'), 1) - 1 AS j FROM p)",
    }


ORACLES = _sql()
