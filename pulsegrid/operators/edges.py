"""Edges from count windows: histograms, thresholds, per-cell state machines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import direction_code, voxel_bin
from ..model import with_position
from .windows import count_windows, n_count_windows, ordered_fold

# The neighbour (dx, dy) that each direction code looks at.
NEIGHBOUR = {2: (0, -1), 3: (-1, -1), 4: (-1, 0), 5: (-1, 1), 6: (0, 1), 7: (1, 1), 8: (1, 0), 9: (1, -1)}


def thresholds(length: int, pixels: int) -> tuple[float, float]:
    """(dense, undense): five deviations above and two below the mean of a binomial."""
    mean = length / pixels
    sigma = math.sqrt(length * (pixels - 1) / pixels**2)
    return mean + 5 * sigma, mean - 2 * sigma


def cells(df: DataFrame, x_min: int, x_max: int, y_min: int, y_max: int, width: int, height: int) -> DataFrame:
    return df.withColumns({"cx": voxel_bin("x", x_min, x_max, width), "cy": voxel_bin("y", y_min, y_max, height)})


def counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts per occupied cell, with signed votes vy = N0 - N2 and vx = N1 - N3 where there is a polarity."""
    vote = lambda a, b: F.sum(F.when(F.col("pol") == a, 1).when(F.col("pol") == b, -1).otherwise(0)).cast("long")
    more = [vote(0, 2).alias("vy"), vote(1, 3).alias("vx")] if "pol" in df.columns else []
    return df.groupBy(*(by or []), "cx", "cy").agg(F.count("*").alias("n"), *more)


def dense_counts(df: DataFrame, width: int, height: int) -> DataFrame:
    """Every cell of the lattice, empty ones with 0."""
    lattice = df.sparkSession.range(width * height).select((F.col("id") % width).cast("int").alias("cx"), F.floor(F.col("id") / width).cast("int").alias("cy"))
    found = counts(df)
    return lattice.join(found, ["cx", "cy"], "left").na.fill(0, [c for c in found.columns if c not in ("cx", "cy")])


def placed_cells(inside: DataFrame, voxel: int, width: int, height: int, x_min: int, y_min: int) -> DataFrame:
    return cells(inside, x_min, x_min + width * voxel, y_min, y_min + height * voxel, width, height)


def inside_of(df: DataFrame, voxel: int, width: int, height: int, x_min: int, y_min: int) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return df.where((x >= x_min) & (x < x_min + width * voxel) & (y >= y_min) & (y < y_min + height * voxel))


def lattice_counts(placed: DataFrame, first: int, n: int, width: int, height: int, length: int) -> DataFrame:
    """(index, cx, cy, n, ..) of every cell in the count windows first .. n - 1; window w ends at length + w hop. placed: cx, cy
    and pos of all events in them."""
    hop = length // 2
    found = counts(count_windows(placed, n * hop + length if n else 0, length, hop).where(F.col("index") >= first * hop + length), ["index"])
    size = width * height
    lattice = placed.sparkSession.range(first * size, n * size).select(
        (F.floor(F.col("id") / size) * hop + length).alias("index"), (F.col("id") % width).cast("int").alias("cx"), (F.floor(F.col("id") / width) % height).cast("int").alias("cy")
    )
    return lattice.join(found, ["index", "cx", "cy"], "left").na.fill(0, [c for c in found.columns if c in ("n", "vx", "vy")])


def window_counts(df: DataFrame, width: int, height: int, voxel: int, length: int, x_min: int = 0, y_min: int = 0) -> tuple[DataFrame, int]:
    """(counts of each window and cell, windows): the dense lattice of every count window."""
    placed = placed_cells(with_position(inside_of(df, voxel, width, height, x_min, y_min)), voxel, width, height, x_min, y_min)
    n = n_count_windows(placed.count(), length, length // 2)
    return lattice_counts(placed, 0, n, width, height, length), n


def edge_states(df: DataFrame, width: int, height: int, voxel: int, length: int, x_min: int = 0, y_min: int = 0) -> DataFrame:
    """(x, y, state, index) of every cell and window: -1 off, 0 on, 1 for the one window of an onset."""
    lattice, _ = window_counts(df, width, height, voxel, length, x_min, y_min)
    return states(lattice, *thresholds(length, width * height)).select("x", "y", "state", "index")


def states(lattice: DataFrame, dense: float, undense: float, before: DataFrame | None = None) -> DataFrame:
    """(x, y, state, index, old, vx, vy). before: (cx, cy, state) of the window before the first one (else all are off)."""

    def step(state, row):
        x, y, index, n, vx, vy, known = row
        if known is not None:
            state[0] = known
            return []
        old = state[0]
        new = 1 if old == -1 and n >= dense else -1 if n <= undense else old
        if old == 1:
            new = 0
        state[0] = new
        return [(x, y, new, index, old, vx, vy)]

    zero = F.lit(0).cast("long")
    have = lattice.select("cx", "cy", "index", "n", *((F.col(c) if c in lattice.columns else zero).alias(c) for c in ("vx", "vy")), F.lit(None).cast("int").alias("known"))
    if before is not None:
        have = have.unionByName(before.select("cx", "cy", F.lit(-1).cast("long").alias("index"), zero.alias("n"), zero.alias("vx"), zero.alias("vy"), F.col("state").alias("known")))
    return ordered_fold(have, ["cx", "cy"], ["index"], ["cx", "cy", "index", "n", "vx", "vy", "known"], "x int, y int, state int, index long, old int, vx long, vy long", lambda key: [-1], step)


def edge_states_directional(df: DataFrame, width: int, height: int, voxel: int, length: int, x_min: int = 0, y_min: int = 0) -> DataFrame:
    """As edge_states, but an onset takes the direction code 2..9 of its votes if the neighbour it points from was on
    (or lies outside the lattice) in the window before, else 1. Only onsets look their neighbour up."""
    lattice, _ = window_counts(df, width, height, voxel, length, x_min, y_min)
    return directed(states(lattice, *thresholds(length, width * height)))


def directed(s: DataFrame) -> DataFrame:
    s = s.withColumn("code", direction_code("vx", "vy"))
    shift = lambda k: F.element_at(F.create_map(*(v for c, d in NEIGHBOUR.items() for v in (F.lit(c), F.lit(d[k])))), F.col("code"))
    onset = s.where("state = 1").select("x", "y", "index", "code", (F.col("x") + shift(0)).alias("nx"), (F.col("y") + shift(1)).alias("ny"))
    old = s.select(F.col("x").alias("nx"), F.col("y").alias("ny"), "index", F.col("old").alias("there"))
    picked = onset.join(old, ["nx", "ny", "index"], "left").select("x", "y", "index", F.when(F.coalesce("there", F.lit(0)) >= 0, F.col("code")).otherwise(1).alias("picked"))
    return s.join(picked, ["x", "y", "index"], "left").select("x", "y", F.coalesce("picked", "state").alias("state"), "index")
