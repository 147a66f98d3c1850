"""Lineage cuts: intermediate tables written to the folder that every executor can reach."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The application's own folder below ``spark.checkpoint.dir``.

    The setting is read from the session. Where it is unset and driver and
    executors are one process, as in tests, a temporary folder takes its place;
    on a cluster that fails, as executors would not see each other's files.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        root, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not root and not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = root or tempfile.mkdtemp(prefix="spark-cut-")
        _FOLDERS[app] = f"{root.rstrip('/')}/seqlake-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _FOLDERS[app])
    return _FOLDERS[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    What follows depends on the written files alone, so a lost executor costs
    no more than the tasks it was running.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete a table written by ``cut`` once nothing reads it any more."""
    for f in {f.rpartition("/")[0] for f in df.inputFiles()[:1]}:
        _remove(df.sparkSession, f)


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    try:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the gateway may be gone when Python ends
        pass
