"""Frame tables for display: sparse (frame, y, x, ..) rows instead of images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import display_point
from .windows import frames, interval_join, nearest_join


#: A table of colours is broadcast up to so many rows.
COLOURS = 1_000_000
#: Powers of a layer's share that are given by the C library, as in SQL; Spark's differ in the last bit at 4, 6, 10, 11, ..
POWERS = 64


def _colours(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(COLOURS + 1).count() <= COLOURS else df


def point_cloud(df: DataFrame, colours: DataFrame | None = None, label: str = "cluster", t_start: int | None = None, t_end: int | None = None, max_points: int | None = None) -> DataFrame:
    from .filters import time_range

    out = time_range(df, t_start, t_end, max_points)
    cols = [*display_point("x", "y", "t")]
    if colours is None:
        return out.select("seq", *cols)
    return out.join(_colours(colours), F.col(label) == F.col("id"), "left").select("seq", *cols, "r", "g", "b")


def binary_frames(df: DataFrame, dt: int, max_frames: int | None = None) -> DataFrame:
    """(frame, y, x, n)."""
    return frames(df, dt, max_frames=max_frames).groupBy("frame", "y", "x").agg(F.count("*").alias("n"))


def label_frames(df: DataFrame, dt: int, label: str, max_frames: int | None = None) -> DataFrame:
    """(frame, y, x, label): the last event of a pixel decides."""
    return frames(df, dt, max_frames=max_frames).groupBy("frame", "y", "x").agg(F.max_by(label, F.struct("t", "seq")).alias(label))


def polarity_frames(df: DataFrame, dt: int, max_frames: int | None = None) -> DataFrame:
    """(frame, y, x, p): ON is painted first and OFF over it."""
    return frames(df, dt, max_frames=max_frames).groupBy("frame", "y", "x").agg(F.min("p").alias("p"))


def alpha_frames(df: DataFrame, dt: int, label: str, colours: DataFrame, alpha: float = 0.3, max_frames: int | None = None) -> DataFrame:
    """(frame, y, x, r, g, b): labels blended in ascending order, each as often as its events, over black."""
    n = frames(df, dt, max_frames=max_frames).groupBy("frame", "y", "x", F.col(label).alias("id")).agg(F.count("*").alias("n"))
    return _blend(n.join(_colours(colours), "id"), ["frame", "y", "x"], alpha)


def _blend(n: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    layers = F.array_sort(F.collect_list(F.struct("id", "n", "r", "g", "b")))  # bounded by the labels of one pixel
    powers = F.array(*(F.lit((1 - alpha) ** k) for k in range(POWERS)))
    beta = lambda s: F.when(s["n"] < POWERS, F.get(powers, s["n"].cast("int"))).otherwise(F.pow(F.lit(1 - alpha), s["n"]))
    ink = lambda c: F.aggregate("l", F.lit(0.0), lambda acc, s: acc * beta(s) + s[c] * (1 - beta(s))).alias(c)
    return n.groupBy(*keys).agg(layers.alias("l")).select(*keys, ink("r"), ink("g"), ink("b"))


def dual_frames(events: DataFrame, states: DataFrame, length_us: int, voxel: int, colours: DataFrame, state_colours: DataFrame, alpha: float = 0.3, box_alpha: float = 0.3) -> DataFrame:
    """(index, y, x, r, g, b): for each state window (index, t, x, y, state) the events of (t - length, t] blended by
    polarity, then the boxes of its cells over them."""
    times = states.select("index", F.col("t").alias("hi")).distinct().withColumn("lo", F.col("hi") - length_us)
    hit = interval_join(events.select("t", "x", "y", "pol"), times, "t", "lo", "hi", length_us)
    under = _blend(hit.groupBy("index", "y", "x", F.col("pol").cast("long").alias("id")).agg(F.count("*").alias("n")).join(_colours(colours), "id"), ["index", "y", "x"], alpha)
    side = F.sequence(F.lit(0), F.lit(voxel - 1))
    boxes = states.join(_colours(state_colours.withColumnRenamed("id", "state")), "state").select("index", "x", "y", "r", "g", "b")
    boxes = boxes.select("index", F.col("x").alias("cx"), F.col("y").alias("cy"), "r", "g", "b", F.explode(side).alias("dx")).select("*", F.explode(side).alias("dy"))
    boxes = boxes.select("index", (F.col("cy") * voxel + F.col("dy")).alias("y"), (F.col("cx") * voxel + F.col("dx")).alias("x"), *(F.col(c).alias(f"{c}2") for c in "rgb"))
    mixed = lambda c: F.when(F.col(f"{c}2").isNull(), F.col(c)).otherwise(F.coalesce(c, F.lit(0.0)) * (1 - box_alpha) + F.col(f"{c}2") * box_alpha).alias(c)
    return under.join(boxes, ["index", "y", "x"], "full").select("index", "y", "x", *(mixed(c) for c in "rgb"))


def vote_arrows(df: DataFrame, dt: int, label: str, max_frames: int | None = None) -> DataFrame:
    """(frame, label, x, y, u, v): an arrow per cluster from its mean place along its signed directions, over 10."""
    vote = lambda a, b: (F.sum(F.when(F.col("pol") == a, 1).when(F.col("pol") == b, -1).otherwise(0)) / 10).alias("u" if a == 1 else "v")
    kept = frames(df, dt, max_frames=max_frames).where(F.col(label) != -1)
    return kept.groupBy("frame", label).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), vote(1, 3), vote(0, 2))


def velocity_arrows(df: DataFrame, velocities: DataFrame, method: str, dt: int, label: str = "cluster_id", scale: float = 1.0, most: int = 100) -> DataFrame:
    """(frame, label, x, y, u, v): the nearest velocity sample of each cluster; at most `most` arrows a frame (the feature
    of the display), lowest labels first."""
    kept = frames(df, dt).where(F.col(label) != -1)
    first = kept.agg(F.min("t")).first()[0] or 0
    at = kept.groupBy("frame", label).agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumn("ft", F.col("frame") * dt + first)
    samples = velocities.select(label, F.col("t").alias("vt"), method)
    near = nearest_join(at, samples, [label], "ft", "vt", [method]).where(F.col(method).isNotNull() & ~F.isnan(F.col(method)[0]))
    from pyspark.sql import Window

    ranked = near.withColumn("__r", F.row_number().over(Window.partitionBy("frame").orderBy(label))).where(F.col("__r") <= most)
    return ranked.select("frame", label, "x", "y", (F.col(method)[0] * scale).alias("u"), (F.col(method)[1] * scale).alias("v"))
