"""Tiling, direction automata and the moving region of interest.

Automata are folds over lanes that never read each other, so each lane is a key of its own (see ordered_fold)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import idiv
from ..plans.staging import staged
from .windows import last_value, ordered_fold, slice_width


def subdivide(df: DataFrame, k: int) -> DataFrame:
    """Adds the tile (py, px) and the place in it (ly, lx)."""
    return df.withColumns({"py": idiv("y", k).cast("int"), "px": idiv("x", k).cast("int"), "ly": (F.col("y") % k).cast("int"), "lx": (F.col("x") % k).cast("int")})


def combine(tiled: DataFrame, k: int) -> DataFrame:
    """Back from tiles to sensor coordinates."""
    return tiled.withColumns({"x": (F.col("px") * k + F.col("lx")).cast("int"), "y": (F.col("py") * k + F.col("ly")).cast("int")}).drop("py", "px", "ly", "lx")


def reduce_to_patches(tiled: DataFrame) -> DataFrame:
    """Events at patch resolution: x, y become the tile."""
    return tiled.withColumns({"x": F.col("px"), "y": F.col("py")}).drop("py", "px", "ly", "lx")


def _lanes(df: DataFrame, k: int) -> DataFrame:
    """Each event in its lane of each of the four directions, with its coordinate v along the sweep."""
    four = F.array(
        F.struct(F.lit(0).alias("dir"), F.col("lx").alias("lane"), F.col("ly").alias("v")),
        F.struct(F.lit(1).alias("dir"), F.col("ly").alias("lane"), F.col("lx").alias("v")),
        F.struct(F.lit(2).alias("dir"), F.col("lx").alias("lane"), (k - 1 - F.col("ly")).alias("v")),
        F.struct(F.lit(3).alias("dir"), F.col("ly").alias("lane"), (k - 1 - F.col("lx")).alias("v")),
    )
    return subdivide(df, k).select("seq", "t", "py", "px", F.explode(four).alias("d")).select("seq", "t", "py", "px", "d.*")


def _sweep(s: int, v: int) -> int:
    return s + 1 if v == s else 0 if v > s else s


def patch_direction(df: DataFrame, k: int, carry: str = "none", fold=ordered_fold) -> DataFrame:
    """(seq, t, x, y, pol): one event for each sweep of all k pixels of a patch's lane in one direction.

    carry='none' starts each patch afresh; carry='raster' starts it in the state in which the patch before it, in raster
    order, ended: each lane's map of states is found in parallel, the maps of a lane number (one short row a patch) are
    composed in order, and each patch is replayed from its known start."""
    lanes = _lanes(df, k)
    keys = ["py", "px", "dir", "lane"]
    if carry == "raster":

        def step_map(m, row):
            for s in range(k):
                m[s] = _sweep(m[s], row[0]) % k
            yield (*row[1:], *[",".join(map(str, m))])

        maps = ordered_fold(lanes, keys, ["t", "seq"], ["v", "py", "px", "dir", "lane", "t", "seq"], "py int, px int, dir int, lane int, t long, seq long, m string", lambda key: list(range(k)), step_map)
        maps = maps.groupBy(*keys).agg(F.max_by("m", F.struct("t", "seq")).alias("m"))

        def step_start(state, row):
            yield (*row[:4], state[0])
            state[0] = int(row[4].split(",")[state[0]])

        starts = ordered_fold(maps, ["dir", "lane"], ["py", "px"], ["py", "px", "dir", "lane", "m"], "py int, px int, dir int, lane int, s0 int", lambda key: [0], step_start)
        lanes = lanes.join(starts, keys)
    else:
        lanes = lanes.withColumn("s0", F.lit(0))

    def step(state, row):
        v, s0, seq, t, px, py, d = row
        if state[0] is None:
            state[0] = s0
        state[0] = _sweep(state[0], v)
        if state[0] == k:
            state[0] = 0
            return [(seq, t, px, py, d)]
        return None

    return fold(lanes, keys, ["t", "seq"], ["v", "s0", "seq", "t", "px", "py", "dir"], "seq long, t long, x int, y int, pol int", lambda key: [None], step)


def multipatch_direction(df: DataFrame, k: int, fold=ordered_fold) -> DataFrame:
    """Of patch direction events, those that end a chain of k neighbouring patches in their direction."""
    lane = df.withColumns({"axis": (F.col("pol") % 2).cast("int"), "lane": F.when(F.col("pol") % 2 == 0, F.col("x")).otherwise(F.col("y")).cast("int"), "at": F.when(F.col("pol") % 2 == 0, F.col("y")).otherwise(F.col("x")).cast("int")})

    def step(s, row):
        at, d, *event = row
        one = 1 if d < 2 else -1  # the way ahead along the lane
        rev = (d + 2) % 4
        s[at, d] = s.get((at - one, d), 0) + 1
        r = s.get((at + one, rev), 0)
        for j in range(r + 1):
            s.pop((at + one * j, rev), None)
        if s[at, d] == k:
            for j in range(k):
                s.pop((at - one * j, d), None)
            return [(*event, d)]
        return None

    return fold(lane, ["axis", "lane"], ["t", "seq"], ["at", "pol", "seq", "t", "x", "y"], "seq long, t long, x int, y int, pol int", lambda key: {}, step)


def roi_writes(roi: DataFrame) -> DataFrame:
    """(bx, by, t, seq, value): the mask cells that each direction event sets ahead of it and clears."""
    x, y = F.col("x"), F.col("y")
    cell = lambda dx, dy, v: F.struct((x + dx).alias("bx"), (y + dy).alias("by"), F.lit(v).alias("value"))
    two = F.when(F.col("pol") == 0, F.array(cell(0, 1, 1), cell(0, -1, 0))).when(F.col("pol") == 1, F.array(cell(1, 0, 1), cell(-1, 0, 0))).when(F.col("pol") == 2, F.array(cell(0, -1, 1), cell(0, 0, 0))).when(F.col("pol") == 3, F.array(cell(-1, 0, 1), cell(0, 0, 0)))
    return roi.select("t", "seq", F.explode(two).alias("w")).select("w.bx", "w.by", "t", "seq", "w.value")


def apply_roi(events: DataFrame, roi: DataFrame, k: int) -> DataFrame:
    """The events whose k x k block the mask holds, by writes strictly before them, between the first and last ROI event."""
    roi = staged(roi.select("t", "seq", "x", "y", "pol"), "roi")  # read for its ends and for its writes
    a, b = roi.agg(F.min("t"), F.max("t")).first()
    cols = events.columns
    e = events.where((F.col("t") > a) & (F.col("t") <= b)) if a is not None else events.where("false")
    e = e.select(F.struct(*cols).alias("row"), idiv("x", k).cast("int").alias("bx"), idiv("y", k).cast("int").alias("by"), "t", "seq", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("value"))
    w = roi_writes(roi).select(F.lit(None).cast(e.schema["row"].dataType).alias("row"), "bx", "by", "t", "seq", F.lit(1).alias("kind"), "value")
    seen = last_value(e.unionByName(w), ["bx", "by"], "t", ["kind", "seq"], "value", "on", slice_width(roi, "t"))
    return seen.where("row is not null and on = 1").select("row.*")


def roi_mask_fold(events: DataFrame, roi: DataFrame, k: int, fold=ordered_fold) -> DataFrame:
    """apply_roi as a fold of each block over its events and writes, which a stream can run too. The stream's last ROI event
    is not known, so only the lower bound holds there by itself: before a first write no block is on."""
    e = events.select(idiv("x", k).cast("int").alias("bx"), idiv("y", k).cast("int").alias("by"), "t", "seq", "x", "y", "p", F.lit(0).alias("kind"), F.lit(0).alias("value"))
    w = roi_writes(roi).select("bx", "by", "t", "seq", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("p"), F.lit(1).alias("kind"), "value")

    def step(s, row):
        kind, value, *event = row
        if kind:
            s[0] = value
            return None
        return [tuple(event)] if s[0] else None

    return fold(e.unionByName(w), ["bx", "by"], ["t", "kind", "seq"], ["kind", "value", "seq", "t", "x", "y", "p"], "seq long, t long, x int, y int, p int", lambda key: [0], step)


def run_filter(events: DataFrame, k_patch: int, k_chain: int, carry: str = "none") -> dict[str, DataFrame]:
    """patch, multi and out: the whole pipeline, lazily."""
    patch = patch_direction(events, k_patch, carry)
    multi = multipatch_direction(patch, k_chain)
    return {"patch": patch, "multi": multi, "out": apply_roi(events, multi, k_patch)}
