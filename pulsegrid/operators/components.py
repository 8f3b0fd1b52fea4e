"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _summary(e: DataFrame) -> tuple[int, int]:
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"] or 0


def _hooked(table: pa.Table) -> pa.Table:
    """(node, root) of a table of edges u > v that fits one task: the larger root of each edge follows the smaller one."""
    nodes, ends = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("u", "v")]), return_inverse=True)
    root, (u, v) = np.arange(len(nodes)), np.split(ends, 2)
    while len(u):
        ru, rv = root[u], root[v]
        apart = ru != rv
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(ru, rv)[apart], np.minimum(ru, rv)[apart])
        while not np.array_equal(up := root[root], root):
            root = up
    return pa.table({"node": nodes, "root": nodes[root]})


def connected_components(edges: DataFrame, stage: Callable[[DataFrame, str], DataFrame], a: str = "a", b: str = "b", drop: Callable[[DataFrame], None] | None = None, small: int = 0) -> DataFrame:
    """(node, root): root is the least node of the component; nodes without an edge to another node are left out.

    Each step takes a minimum by node (with map-side combine) and joins it back to the edges, which AQE splits where a
    node has very many; no list of neighbours is ever gathered. Rounds grow with the logarithm of the diameter. `stage`
    cuts the lineage between rounds (a checkpoint or a written table); `drop`, if given, deletes what it wrote once nothing
    reads that, and the result is then staged as well. A graph of at most `small` edges is done by one task at once.
    """
    x, y = F.col(a), F.col(b)
    e = edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    e = stage(e, "edges")
    before = _summary(e)
    if 0 < before[0] <= small:
        out = stage(e.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_hooked, "node long, root long"), "roots")
        if drop:
            drop(e)
        return out
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("k"), F.least("u", "w").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        spent, e = e, stage(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if drop:
            drop(spent)
        now = _summary(e)
        if now == before:
            break
        before = now
    out = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
    if drop:
        out = stage(out, "roots")
        drop(e)
    return out


def contracted_components(edges: DataFrame, stage: Callable[[DataFrame, str], DataFrame], a: str = "a", b: str = "b", drop: Callable[[DataFrame], None] = lambda df: None, small: int = 0) -> DataFrame:
    """As connected_components, for graphs that hardly shrink by its stars, such as trees: each round makes one node of those
    that point at the same one, so its nodes are less than half of those before. A node points at its least neighbour by hash (by
    number, a path in order would hardly contract), the lower of two that point at each other at itself, and then once more on. A
    node is named after its least one. From `small` edges on one task does the rest."""
    x, y = F.col(a), F.col(b)
    rank = F.struct(F.xxhash64("v").alias("hash"), F.col("v").alias("node"))
    onto = lambda df: df.select(F.col("node").alias("to"), F.col("to").alias("far"))
    e, levels = stage(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges"), []
    while (n := e.count()) > small:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = stage(both.groupBy("u").agg(F.min(rank)["node"].alias("to")).withColumnRenamed("u", "node"), "near")
        up = stage(near.join(onto(near), "to").select("node", F.when(F.col("far") == F.col("node"), F.least("node", "to")).otherwise(F.col("to")).alias("to")), "up")
        far = up.join(onto(up), "to").select("node", "far")
        level = stage(far.join(far.groupBy("far").agg(F.min("node").alias("root")), "far").select("node", "root"), "level")
        ends = [level.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "uv"]
        fewer = e.join(ends[0], "u").join(ends[1], "v").where("ru <> rv").select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v")).distinct()
        spent, e = (e, near, up), stage(fewer, "edges")
        levels.append(level)
        for df in spent:
            drop(df)
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    if n:
        out = e.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_hooked, "node long, root long")
    out = stage(out, "roots")
    drop(e)
    for level in reversed(levels):
        above = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        spent, out = (out, level), stage(level.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
        for df in spent:
            drop(df)
    return out
