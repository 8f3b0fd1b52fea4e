"""Streams that need a global order: event-time buffering, running positions, and operators that go on where they stopped.

A stream is worked off in micro-batches. What a batch leaves to the next one lies in tables of a folder that all executors
share, by number of batch, and a batch is committed by one small file, written last; so a batch that is repeated after a
failure reads what the batch before it left and writes its results over its own.

Rows may come late by `late` units of t. A batch takes up what has come, works on the rows up to the newest t seen less
`late`, in (t, seq) order, and keeps the others; rows that come later than that are left out and counted. So any arrival
order within the bound gives what the batch operator gives on the whole table. finish() works on what is still kept.

The work on a batch is that of the batch operators: positions by a range sort, folds by cell, components by frame. Only
counters, a trigger's clusters and bounds pass through the driver."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..model import with_position
from ..operators import edges
from ..operators.dstream import Carry, DStream
from ..operators.windows import n_count_windows
from ..plans.staging import staged

Process = Callable[[DataFrame, "Tables"], None]


class Tables:
    """The tables and counters that the batches before `batch` left in the folder, and those of this batch."""

    def __init__(self, spark: SparkSession, folder: str, batch: int):
        self.spark, self.folder, self.batch = spark, folder.rstrip("/"), batch
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = [int(f.getPath().getName()) for f in self._fs.listStatus(path)] if self._fs.exists(path) else []
        before = [b for b in done if b < batch]
        held = {}
        if before:
            held = json.loads("".join(r["value"] for r in spark.read.text(f"{self.folder}/commits/{max(before)}").collect()))
        self._paths: dict[str, list[str]] = held.get("tables", {})  # name: [path, schema]
        self._before = {p for p, _ in self._paths.values()}
        self.values: dict[str, Any] = held.get("values", {})

    def read(self, name: str) -> DataFrame | None:
        if name not in self._paths:
            return None
        path, schema = self._paths[name]
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(path)

    def write(self, name: str, df: DataFrame | None) -> None:
        if df is None:
            self._paths.pop(name, None)
            return
        path = f"{self.folder}/{name}/{self.batch}"
        df.write.mode("overwrite").parquet(path)
        self._paths[name] = [path, df.schema.json()]

    def emit(self, df: DataFrame, out: str) -> None:
        """Results of this batch; a repeated batch writes over its own."""
        df.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={self.batch}")

    def commit(self) -> None:
        held = json.dumps({"tables": self._paths, "values": self.values})
        self.spark.createDataFrame([(held,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/commits/{self.batch}")
        # What neither this batch nor a repetition of it reads goes.
        named = self._before | {p for p, _ in self._paths.values()}
        for name in {p.rsplit("/", 2)[1] for p in named}:
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            for f in self._fs.listStatus(folder):
                if f"{self.folder}/{name}/{f.getPath().getName()}" not in named and int(f.getPath().getName()) < self.batch:
                    self._fs.delete(f.getPath(), True)


def _take(spark: SparkSession, folder: str, batch: int, rows: DataFrame | None, process: Process, late: int | None) -> None:
    tables = Tables(spark, folder, batch)
    v = tables.values
    kept, cut = tables.read("waiting"), v.get("cut")
    if rows is not None:
        fresh = rows if cut is None else rows.where(F.col("t") > cut)
        both = staged(fresh if kept is None else kept.unionByName(fresh.select(*kept.columns)), "arrived")
        if cut is not None:
            v["left_out"] = v.get("left_out", 0) + rows.where(F.col("t") <= cut).count()
    elif kept is not None:
        both = kept
    else:
        return
    newest = both.agg(F.max("t")).first()[0]
    if newest is None:
        tables.commit()
        return
    v["newest"] = max(newest, v.get("newest", newest))
    now = v["newest"] if late is None else v["newest"] - late
    v["cut"] = max(now, cut) if cut is not None else now
    ready = both.where(F.col("t") <= v["cut"])
    if not ready.isEmpty():
        process(ready, tables)
    tables.write("waiting", both.where(F.col("t") > v["cut"]))
    tables.commit()


def run(stream: DataFrame, folder: str, process: Process, late: int, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that hands the rows of the stream (with t and seq) to `process` in their order."""
    spark = stream.sparkSession
    # Batches are numbered from 1; finish() takes the number after the last one.
    each = lambda rows, batch: _take(spark, folder, batch + 1, rows, process, late)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder.rstrip('/')}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def finish(spark: SparkSession, folder: str, process: Process) -> None:
    """Works on the rows that still wait, once the query has ended."""
    last = Tables(spark, folder, 2**62)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/commits")
    if last._fs.exists(path):
        _take(spark, folder, max(int(f.getPath().getName()) for f in last._fs.listStatus(path)) + 1, None, process, None)


def edge_windows(out: str, width: int, height: int, voxel: int, length: int, x_min: int = 0, y_min: int = 0, directional: bool = False) -> Process:
    """edge_states (or edge_states_directional) of the count windows that each batch completes, written to `out`. Kept are the
    running position, the events from the next window's start on (fewer than length + hop) and one state a cell."""
    hop = length // 2
    dense, undense = edges.thresholds(length, width * height)

    def process(ready: DataFrame, tables: Tables) -> None:
        n, first = tables.values.get("n", 0), tables.values.get("windows", 0)
        own = with_position(edges.inside_of(ready, voxel, width, height, x_min, y_min)).withColumn("pos", F.col("pos") + n)
        own = staged(edges.placed_cells(own, voxel, width, height, x_min, y_min).select("pos", "cx", "cy", *[c for c in ("pol",) if c in ready.columns]), "cells")
        tail = tables.read("tail")
        placed = own if tail is None else tail.unionByName(own)
        total = n + own.count()
        last = max(first, n_count_windows(total, length, hop))
        if last > first:
            found = staged(edges.states(edges.lattice_counts(placed, first, last, width, height, length), dense, undense, tables.read("states")), "states")
            tables.emit(edges.directed(found) if directional else found.select("x", "y", "state", "index"), out)
            tables.write("states", found.where(F.col("index") == (last - 1) * hop + length).select(F.col("x").alias("cx"), F.col("y").alias("cy"), "state"))
        tables.write("tail", placed.where(F.col("pos") >= last * hop))
        tables.values |= {"n": total, "windows": last}

    return process


def stream_edge_states(stream: DataFrame, folder: str, out: str, late: int = 0, trigger: dict | None = None, **options) -> StreamingQuery:
    """Edge states of a stream of events; options as edge_windows."""
    return run(stream, folder, edge_windows(out, **options), late, trigger)


def dstream_labels(out: str, model: DStream, label: str = "cluster_id") -> Process:
    """Each event with its D-Stream label, written to `out`. Kept are the cells' decayed counts and the last trigger's clusters
    (both at most the lattice), when the next trigger is due and the next id. An id whose cluster is gone is forgotten with
    the trigger that does not find it."""

    def process(ready: DataFrame, tables: Tables) -> None:
        v = tables.values
        carry = Carry(tables.read("cells"), tables.read("last"), v.get("frame", 0), tuple(v["at"]) if v.get("at") else None, v.get("due"), v.get("next_id", 1))
        labelled, carry = model.advance(staged(ready, "ready"), carry, label)
        tables.emit(labelled, out)
        tables.write("cells", carry.cells)
        tables.write("last", carry.last)
        v |= {"frame": carry.frame, "at": carry.at, "due": carry.due, "next_id": carry.next_id}

    return process


def stream_dstream(stream: DataFrame, folder: str, out: str, model: DStream | None = None, late: int = 0, trigger: dict | None = None, label: str = "cluster_id") -> StreamingQuery:
    """D-Stream labels of a stream of events."""
    return run(stream, folder, dstream_labels(out, model or DStream(), label), late, trigger)
