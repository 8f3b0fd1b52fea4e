"""The event model: (seq, t, x, y, p, ..) rows with an explicit total order (t, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .plans.staging import staged

NOISE = -1
WIDTH, HEIGHT = 64, 36  # of the sensor that cam_events makes up


def cam_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events table as camera events on a 64 x 36 sensor: seq, t, x, y, p, pol, obj."""
    ev = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    start = ev.select(F.min(us)).scalar()
    kind, user = F.col("event_type"), F.col("user_id")
    return ev.select(
        F.col("event_id").alias("seq"),
        F.floor((us - start) / 10000).cast("long").alias("t"),
        (user % 64).cast("int").alias("x"),
        (F.floor("value") % 36).cast("int").alias("y"),
        kind.isin("click", "purchase").cast("int").alias("p"),
        F.when(kind == "click", 0).when(kind == "error", 1).when(kind == "purchase", 2).when(kind == "signup", 3).otherwise(user % 4).cast("int").alias("pol"),
        F.when(kind == "view", NOISE).otherwise(user % 8).cast("int").alias("obj"),
    )


CAM_SQL = """
cam as (
  select event_id as seq, (epoch_us(ts) - (select min(epoch_us(ts)) from events)) // 10000 as t,
    (user_id % 64)::int as x, (floor(value)::bigint % 36)::int as y, (event_type in ('click', 'purchase'))::int as p,
    (case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else user_id % 4 end)::int as pol,
    (case when event_type = 'view' then -1 else user_id % 8 end)::int as obj
  from events)
"""


def with_position(df: DataFrame, *order: str | Column, name: str = "pos") -> DataFrame:
    """Adds the 0-based global position by `order` without a single-partition window: a range sort, written once so that
    positions stay fixed, and per-partition counts (one row a partition) as offsets."""
    sort = order or ("t", "seq")
    placed = staged(df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__m", F.monotonically_increasing_id()), "position")
    part = F.shiftright("__m", 33)
    counts = placed.groupBy(part.alias("__p")).agg(F.count("*").alias("n"))
    offsets = counts.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("__o"))
    return placed.withColumn("__p", part).join(F.broadcast(offsets), "__p").withColumn(name, F.col("__o") + F.col("__m").bitwiseAND((1 << 33) - 1)).drop("__m", "__p", "__o")
