"""Scalar expressions over event columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(a: str | Column, n: int) -> Column:
    """Floor division by a positive whole number, exact for longs."""
    a = _c(a)
    return ((a - F.pmod(a, F.lit(n))) / n).cast("long")


def pixel_xy(pix: str | Column, width: int) -> tuple[Column, Column]:
    """(x, y) of a linear pixel."""
    return F.pmod(_c(pix), F.lit(width)).cast("int").alias("x"), idiv(pix, width).cast("int").alias("y")


def linear_pixel(x: str | Column, y: str | Column, width: int) -> Column:
    return _c(x).cast("long") + _c(y).cast("long") * width


def time_feature(t: str | Column, scale: float) -> Column:
    """t * scale as float32; pass 1/threshold or eps_s/eps_t for the other two scalings."""
    return (_c(t).cast("double") * F.lit(float(scale))).cast("float")


def grid_cell(x: str | Column, y: str | Column, g: int) -> tuple[Column, Column]:
    return idiv(x, g).cast("int").alias("gx"), idiv(y, g).cast("int").alias("gy")


def voxel_bin(v: str | Column, low: float, high: float, n: int) -> Column:
    """Equal bins of [low, high), truncated toward zero and clamped to 0..n-1."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), ((_c(v) - F.lit(low)) / F.lit((high - low) / n)).cast("int")))


def display_point(x: str | Column, y: str | Column, t: str | Column) -> list[Column]:
    return [_c(x).cast("double").alias("px"), (_c(t) / 1000).alias("py"), _c(y).cast("double").alias("pz")]


def first_column(df: DataFrame, *names: str) -> str:
    """The first of the names df has."""
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of {', '.join(names)} among {', '.join(df.columns)}")


def polarity_column(df: DataFrame) -> str:
    return first_column(df, "polarity", "pol", "p")


def cluster_column(df: DataFrame) -> str:
    return first_column(df, "cluster_id", "cluster")


def direction_code(vx: str | Column, vy: str | Column) -> Column:
    """The code 2..9 of a direction; at vx = 0 the sense of y is the opposite of the other cases."""
    vx, vy = _c(vx), _c(vy)
    m = vy / vx
    pick = lambda *codes: F.when(m < -2.5, codes[0]).when(m < -0.4, codes[1]).when(m < 0.4, codes[2]).when(m < 2.5, codes[3]).otherwise(codes[4])
    return F.when(vx == 0, F.when(vy > 0, 2).otherwise(6)).when(vx > 0, pick(2, 3, 4, 5, 6)).otherwise(pick(6, 7, 8, 9, 2)).cast("int")


def palette(spark: SparkSession, ids: list[int], fixed: dict[int, tuple[float, float, float]] | None = None) -> DataFrame:
    """(id, r, g, b): seeded colours over the sorted distinct ids, noise black, fixed ones as given."""
    ids = sorted(set(ids))
    rgb = np.random.default_rng(42).random((len(ids), 3))
    rows = []
    for k, i in enumerate(ids):
        c = (fixed or {}).get(i) or ((0.0, 0.0, 0.0) if i == -1 else tuple(rgb[k].tolist()))
        rows.append((i, *map(float, c)))
    return spark.createDataFrame(rows, "id long, r double, g double, b double")
