"""Cutting lineage through the folder all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_kept: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset and all tasks run in this process (tests) a local folder is made."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="pulsegrid-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame, tag: str = "stage") -> DataFrame:
    """df written as Parquet to the shared folder and read back.

    A written table is compact, survives lost executors and is committed task by task, so what a task derived from its
    own partition (such as an order of rows) stays fixed when later stages are retried. It stays until discard() or the
    end of the session, since results that are not yet computed may read it."""
    path = f"{shared_dir(df.sparkSession)}/pulsegrid-{tag}-{uuid.uuid4().hex}"
    if not _kept:
        atexit.register(_clean)  # after Spark's own, so it runs before that
    _kept.add(path)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def _delete(sc: SparkContext, path: str) -> None:
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    _kept.discard(path)


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing still to be computed reads."""
    for df in tables:
        _delete(df.sparkSession.sparkContext, df.staged_at)


def _clean() -> None:
    with contextlib.suppress(Exception):  # the session may be gone; the folder is then cleaned with it
        if (sc := SparkContext._active_spark_context) and sc._jsc:
            for path in list(_kept):
                _delete(sc, path)
