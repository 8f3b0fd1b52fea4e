"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def time_cut(df: DataFrame, t: str = "t") -> DataFrame:
    """max/10 < t < 2 max/5, of the largest t of the uncut table (a scalar subquery)."""
    top = df.select(F.max(t)).scalar()
    return df.where((F.col(t) > top / 10) & (F.col(t) < top * 2 / 5))


def spatial_crop(df: DataFrame, x_min: int, x_max: int, y_min: int, y_max: int) -> DataFrame:
    return df.where((F.col("x") >= x_min) & (F.col("x") < x_max) & (F.col("y") >= y_min) & (F.col("y") < y_max))


def time_range(df: DataFrame, t_start: int | None = None, t_end: int | None = None, max_points: int | None = None) -> DataFrame:
    """Inclusive bounds, then the first max_points by (t, seq)."""
    if t_start is not None:
        df = df.where(F.col("t") >= t_start)
    if t_end is not None:
        df = df.where(F.col("t") <= t_end)
    return df if max_points is None else df.orderBy("t", "seq").limit(max_points)


def drop_noise(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label) != -1)


def exclude_ids(df: DataFrame, label: str, ids: list[int]) -> DataFrame:
    return df.where(~F.col(label).isin(*ids)) if ids else df


def polarity_subset(df: DataFrame, pol: int, column: str = "pol") -> DataFrame:
    return df.where(F.col(column) == pol)


def valid_vector(*columns: str) -> Column:
    """Whether no component of the array columns is NaN or null."""
    out = F.lit(True)
    for c in columns:
        out = out & ~F.exists(c, lambda v: v.isNull() | F.isnan(v)) & F.col(c).isNotNull()
    return out
