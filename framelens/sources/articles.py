"""Reading and writing articles: JSON, CSV and Parquet, on any file system Spark knows; a cache keyed by path and version."""

from __future__ import annotations

import hashlib
import json
import logging
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)

#: A fixed schema: inference would make a struct of whichever groups occur.
CODING_TYPE = T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))
ARTICLE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("article_id", "source", "date", "title", "content", "url")] + [T.StructField("human_coding", CODING_TYPE)] + [T.StructField(c, T.StringType()) for c in ("author", "section")])
REQUIRED = ("article_id", "source", "date", "title", "content", "human_coding")
DEFAULT_PATHS = ("data/articles.json", "data/sample_articles.json")


def _fs_path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs_path(spark, path)
    return fs.exists(jpath)


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Articles of a JSON array (or of JSON lines). A missing file is an error at once."""
    if not exists(spark, path):
        raise FileNotFoundError(f"data file not found: {path}")
    return spark.read.schema(ARTICLE_SCHEMA).option("multiLine", not lines).json(path)


def read_articles(spark: SparkSession, path: str | None = None, source: str | None = None) -> DataFrame:
    """Articles by the path's ending (.parquet, .jsonl, .csv, else a JSON array), or from the first default path that exists."""
    if path is None:
        path = next((p for p in DEFAULT_PATHS if exists(spark, p)), None)
        if path is None:
            raise FileNotFoundError("no data file in the usual places")
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind == "csv":
        df = read_csv(spark, path)
    else:
        df = read_json(spark, path, lines=kind in ("jsonl", "ndjson"))
    return df if source is None else df.where(F.col("source") == source)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV as ``write`` makes it: the coding is a JSON string."""
    flat = T.StructType([f if f.name != "human_coding" else T.StructField(f.name, T.StringType()) for f in ARTICLE_SCHEMA])
    df = spark.read.schema(flat).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.withColumn("human_coding", F.from_json("human_coding", CODING_TYPE))


def missing_fields(df: DataFrame) -> list[str]:
    return [c for c in REQUIRED if c not in df.columns]


def incomplete(df: DataFrame) -> DataFrame:
    """(article_id, missing): the required fields that are null in a row, in their order; complete rows are left out. A column
    that isn't there is missing in every row."""
    lacking = [F.lit(c) if c not in df.columns else F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]
    key = F.col("article_id") if "article_id" in df.columns else F.lit(None).cast("string").alias("article_id")
    return df.select(key, F.array_compact(F.array(*lacking)).alias("missing")).where(F.size("missing") > 0)


def _plain(df: DataFrame) -> DataFrame:
    """Nested columns as JSON strings, for formats without nesting."""
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.MapType | T.ArrayType | T.StructType) else F.col(f.name) for f in df.schema))


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite", compress: bool = False) -> None:
    """Parquet (also for 'pickle', which it replaces), JSON lines, or CSV with a header; gzip on request."""
    w = (_plain(df) if format == "csv" else df).write.mode(mode)
    if format in ("parquet", "pickle"):
        w.parquet(path)
    elif format == "json":
        (w.option("compression", "gzip") if compress else w).json(path)
    elif format == "csv":
        w = w.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        (w.option("compression", "gzip") if compress else w).csv(path)
    else:
        raise ValueError(f"unknown format: {format}")


def save_results(results: dict[str, Any] | DataFrame, path: str, format: str = "json") -> None:
    """A small dict of results to one file (json or csv, on the driver), or a DataFrame by ``write``."""
    if isinstance(results, DataFrame):
        return write(results, path, format)
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    if format == "json":
        target.write_text(json.dumps(results, indent=2, default=str, ensure_ascii=False), encoding="utf-8")
    elif format in ("csv", "pickle"):
        import pandas as pd

        frame = pd.DataFrame(results)
        frame.to_csv(target, index=False) if format == "csv" else frame.to_pickle(target)
    else:
        raise ValueError(f"unknown format: {format}")
    return None


class Articles:
    """Articles of one path, read when they are first asked for and kept then."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path
        self._all: DataFrame | None = None
        self._own: dict[str | None, DataFrame] = {}

    def load(self) -> DataFrame:
        """All articles as read, each delivery."""
        if self._all is None:
            self._all = read_articles(self.spark, self.path)
        return self._all

    def articles(self, source: str | None = None) -> DataFrame:
        """Articles with their lengths, of one source if named."""
        from framelens.operators.corpus import load_articles

        if source not in self._own:
            self._own[source] = load_articles(self.load(), source)
        return self._own[source]


class Cache:
    """DataFrames kept as Parquet under md5(path_version). Failures to read or write are logged, not raised."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @staticmethod
    def key(path: str, version: str = "v1") -> str:
        return hashlib.md5(f"{path}_{version}".encode()).hexdigest()

    def path(self, path: str, version: str = "v1") -> str:
        return f"{self.folder}/{self.key(path, version)}.parquet"

    def load(self, path: str, version: str = "v1") -> DataFrame | None:
        try:
            at = self.path(path, version)
            return self.spark.read.parquet(at) if exists(self.spark, at) else None
        except Exception as e:
            log.warning("cache not read: %s", e)
            return None

    def save(self, df: DataFrame, path: str, version: str = "v1") -> None:
        try:
            df.write.mode("overwrite").parquet(self.path(path, version))
        except Exception as e:
            log.warning("cache not written: %s", e)

    def clear(self) -> None:
        fs, folder = _fs_path(self.spark, self.folder)
        if fs.exists(folder):
            for s in fs.listStatus(folder):
                if s.getPath().getName().endswith(".parquet"):
                    fs.delete(s.getPath(), True)
