"""Config, report, streaming, the registry against SQL, and independence of the optional subpackage."""

from __future__ import annotations

import ast
import json
import time
from pathlib import Path

import pytest

from framelens import config, report
from framelens.operators.detect import KeywordDetector

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


def test_config(tmp_path):
    good = {"loading": {}, "splitting": {"train_ratio": 0.6, "val_ratio": 0.2, "test_ratio": 0.2}, "human_coding": {"frame_types": ["x"]}, "metadata": {}, "local": {"cache_dir": str(tmp_path / "c"), "articles_file": "a"}, "colab": {"cache_dir": "z"}}
    (tmp_path / "data_config.json").write_text(json.dumps(good))
    m = config.ConfigManager(tmp_path)
    assert m.load("data_config")["cache_dir"].endswith("/c") and config.ConfigManager(tmp_path, "colab").load("data_config")["cache_dir"] == "z"
    m.create_directories()
    assert (tmp_path / "c").is_dir() and set(m.paths()) == {"cache_dir", "articles_file"}
    m.update("data_config", {"splitting": {"val_ratio": 0.1}})
    assert m.load("data_config")["splitting"] == {"train_ratio": 0.6, "val_ratio": 0.1, "test_ratio": 0.2}
    m.save("data_config", tmp_path / "saved.yaml")
    with pytest.raises(ValueError):
        m.check("data_config", config.read_config(tmp_path / "saved.yaml"))
    for error, act in ((FileNotFoundError, lambda: m.load("nothing")), (ValueError, lambda: m.save("nothing")), (ValueError, lambda: m.check("model_config", {})), (ValueError, lambda: m.check("frame_definitions", {"frames": {}}))):
        with pytest.raises(error):
            act()
    (tmp_path / "model_config.json").write_text(json.dumps({"zero_shot": {"t": 1}, "fine_tuning": {"learning_rate": 1, "batch_size": 999}, "preprocessing": {}}))
    assert m.model_params() == {"t": 1}
    with pytest.raises(ValueError):
        m.model_params("none")


def test_report():
    text = report.format_results({"summary": {"n": 3}, "demographic_analysis": {"women": {"obstacles": 2}}})
    assert "Summary Statistics:\n  n: 3" in text and "\n\n  women:\n    obstacles: 2" in text
    with report.Timer() as t:
        time.sleep(0.01)
    assert t.seconds >= 0.01 and report.hash_text("a") == "0cc175b9c0f1b6a831c399e269772661"
    assert list(report.batch_iterator([1, 2, 3], 2)) == [[1, 2], [3]]


def test_stream(spark, tmp_path):
    from framelens.streaming import articles as T

    rows = [{"article_id": f"a{i}", "source": "s", "content": "only men" if i % 2 else "a barrier", "ingested_at": f"2024-01-0{1 + i % 3}T00:00:00"} for i in range(6)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows + rows[:2])))
    (tmp_path / "in" / "2.json").write_text(json.dumps({"article_id": "late", "source": "s", "content": "x", "ingested_at": "2024-03-01T00:00:00"}))
    s = T.scored(T.first_deliveries(T.read_stream(spark, str(tmp_path / "in"), 1)), KeywordDetector())
    q = T.write_stream(T.frame_counts(s), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    got = {(r["frame"], str(r["start"])[:10]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sum(got.values()) == 6 and got["obstacles", "2024-01-01"] == 1


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_queries_equal_their_sql(spark):
    import duckdb

    from framelens.plans import analysis, nested
    from framelens.plans.oracles import ORACLES

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    assert set(ORACLES) == set(analysis.QUERIES)

    def plain(v):
        return round(float(v), 4) + 0.0 if isinstance(v, int | float) and not isinstance(v, bool) else int(v) if isinstance(v, bool) else v

    for name, sql in (ORACLES | nested.ORACLES).items():
        df = (analysis.QUERIES | nested.QUERIES)[name](spark, str(DATA))
        res = con.execute(sql)
        cols = [c[0] for c in res.description]
        assert sorted(cols) == sorted(df.columns), name
        want = sorted((tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in res.fetchall()), key=str)
        got = sorted((tuple(plain(r[c]) for c in sorted(cols)) for r in df.collect()), key=str)
        assert got == want, name


def test_nothing_else_uses_the_optional_subpackage():
    for p in ROOT.glob("framelens/**/*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] + [getattr(node, "module", "") or ""] if isinstance(node, ast.Import | ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), p


def test_filters_and_columns_reach_the_scan(spark):
    if not DATA.exists():
        pytest.skip("no test data")
    from framelens.plans import analysis

    plan = analysis.source_filter(spark, str(DATA))._jdf.queryExecution().toString()
    assert "EqualTo(source,Shamidun Ledger)" in plan and "human_coding" not in plan.split("ReadSchema")[-1].split("\n")[0]
