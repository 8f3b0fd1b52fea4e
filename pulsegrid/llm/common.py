"""Shared plumbing: reading tables, staging in the shared folder, row identity."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.plans.staging import discard, staged

__all__ = ["discard", "map_rows", "quoted", "shuffle_partitions", "slices", "staged", "table", "text_rows", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) with null text as the empty string; every other column is left behind, so names
    cannot clash."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while any(c.startswith(n) for c in taken):
            n = f"_{n}"
        out.append(n)
    return out


def quoted(name: str) -> str:
    """A column name with dots or backquotes in it, as an expression takes it."""
    return "`" + name.replace("`", "``") + "`"


def map_rows(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """df through a function of Arrow batches that keeps the columns, whatever their names: meanwhile they are numbered."""
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return plain.mapInArrow(work, plain.schema).toDF(*df.columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of a few rows, so that what is made of a batch at once stays small; at the end of the task
    its memory goes back to the system, since Python workers live on and share their executor's memory."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        del batch
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)
