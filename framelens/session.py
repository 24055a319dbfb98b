"""Session helpers: shipping the package to executors, spreading small inputs, and cutting lineage in shared storage."""

from __future__ import annotations

import atexit
import logging
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application. Needed by every operator with Python workers."""
    sc = spark.sparkContext
    if getattr(sc, "_framelens_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="framelens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / "framelens.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("framelens") / p.relative_to(root))
    sc.addPyFile(str(path))
    sc._framelens_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Where it is unset, a folder of our own is made if driver and executors are one process (tests, one machine); else it is
    an error, as executors of a cluster don't see each other's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        own = tempfile.mkdtemp(prefix="framelens-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder. It is deleted when the application ends."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/framelens-{sc.applicationId}"
    if getattr(sc, "_framelens_own", None) != path:
        sc._framelens_own = path
        stop = sc.stop

        def clean_and_stop() -> None:
            _delete(sc, path)
            stop()

        sc.stop = clean_and_stop
        atexit.register(_delete, sc, path)
    return path


def _delete(sc: SparkContext, path: str) -> None:
    """Nothing is raised at the end of an application; a context that is stopped already has deleted its folder."""
    try:
        if sc._jsc is not None:
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    except Exception as e:
        log.warning("not deleted: %s: %s", path, e)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._framelens_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the table of a cut that nothing will read again (the rounds of an iteration)."""
    _delete(df.sparkSession.sparkContext, df._framelens_path)


#: Rows of a table of keys that is broadcast: of some 40 bytes each, 16 MB at most.
BROADCAST_ROWS = 400_000


def small(keys: DataFrame) -> DataFrame:
    """keys to be broadcast if they are counted to be few, else as they are."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def spread(df: DataFrame, at_least: int | None = None, like: DataFrame | None = None) -> DataFrame:
    """More partitions for heavy per-row work where the input has fewer than the cluster has cores (small files only).

    ``like``: what df is read from, if df is more than a scan, so that counting its partitions runs nothing.
    """
    want = at_least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if (like or df).rdd.getNumPartitions() < want else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
