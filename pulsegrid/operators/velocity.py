"""Velocity of clusters on a regular grid of times, four ways, and their evaluation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged
from .windows import asof_join, decayed_sums

NAN = float("nan")
METHODS = ("limit", "momentum", "votes", "decay_votes")


def grid(df: DataFrame, dt: int, cluster: str) -> DataFrame:
    """(cluster, m, t): t = t_min + m dt strictly between t_min and t_max."""
    ends = df.groupBy(cluster).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    n = F.ceil((F.col("b") - F.col("a")) / dt) - 1
    return ends.withColumn("n", n).where("n >= 1").select(cluster, "a", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("m")).select(cluster, "m", (F.col("a") + F.col("m") * dt).alias("t"))


def _buckets(df: DataFrame, dt: int, cluster: str) -> DataFrame:
    ends = df.groupBy(cluster).agg(F.min("t").alias("a"))
    return df.join(ends, cluster).withColumn("b", F.floor((F.col("t") - F.col("a")) / dt))


def _vector(x: Column, y: Column, valid: Column) -> Column:
    return F.when(valid, F.array(x, y)).otherwise(F.array(F.lit(NAN), F.lit(NAN)))


def limit_velocity(df: DataFrame, dt: int, cluster: str = "cluster_id") -> DataFrame:
    """Centroids of the windows after and before each time, over the difference of their mean times."""
    b = _buckets(df, dt, cluster).groupBy(cluster, "b").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("t").alias("mt"))
    lo = b.select(cluster, (F.col("b") + 1).alias("m"), *(F.col(c).alias(f"{c}0") for c in ("x", "y", "mt")))
    hi = b.select(cluster, F.col("b").alias("m"), *(F.col(c).alias(f"{c}1") for c in ("x", "y", "mt")))
    g = grid(df, dt, cluster).join(lo, [cluster, "m"], "left").join(hi, [cluster, "m"], "left")
    span = F.col("mt1") - F.col("mt0")
    return g.select(cluster, "t", _vector((F.col("x1") - F.col("x0")) / span, (F.col("y1") - F.col("y0")) / span, F.col("mt0").isNotNull() & F.col("mt1").isNotNull()).alias("limit"))


def votes_velocity(df: DataFrame, dt: int, cluster: str = "cluster_id", pol: str | None = "pol") -> DataFrame:
    """Shares of signed directions in the window before each time."""
    g = grid(df, dt, cluster)
    if pol is None:
        return g.select(cluster, "t", F.array(F.lit(NAN), F.lit(NAN)).alias("votes"))
    n = lambda a, b: F.sum(F.when(F.col(pol) == a, 1).when(F.col(pol) == b, -1).otherwise(0))
    c = _buckets(df, dt, cluster).groupBy(cluster, (F.col("b") + 1).alias("m")).agg(F.count("*").alias("n"), n(1, 3).alias("u"), n(0, 2).alias("v"))
    return g.join(c, [cluster, "m"], "left").select(cluster, "t", _vector(F.col("u") / F.col("n"), F.col("v") / F.col("n"), F.col("n").isNotNull()).alias("votes"))


def _sampled(g: DataFrame, path: DataFrame, cluster: str, name: str) -> DataFrame:
    left = g.select(cluster, "t", F.col("m").alias("seq"))
    out = asof_join(left, path, [cluster], "t", "t", name)
    return out.select(cluster, "t", F.coalesce(name, F.array(F.lit(NAN), F.lit(NAN))).alias(name))


def momentum_path(df: DataFrame, dt: int, cluster: str = "cluster_id", fold=None) -> DataFrame:
    """(cluster, t, seq, momentum) after each event: the velocity of a centre of mass that decays with time constant dt,
    itself averaged alike. Both are decayed sums; a stream steps through them by a fold."""
    if fold is None:
        rows = df.select(cluster, "t", "seq", "x", "y")
        mass = decayed_sums(rows, [cluster], "t", ["seq"], dt, {"m": F.lit(1.0), "ax": F.col("x"), "ay": F.col("y")})
        mass = staged(mass.select(cluster, "t", "seq", "x", "y", "m", (F.col("ax") / F.col("m")).alias("cx"), (F.col("ay") / F.col("m")).alias("cy")), "mass")
        shift = decayed_sums(mass, [cluster], "t", ["seq"], dt, {}, {"t0": "t", "cx0": "cx", "cy0": "cy"})
        gap = F.col("t") - F.col("t0")
        push = {c: F.coalesce(F.when(gap > 0, (F.col(c[1]) - F.col(f"c{c[1]}0")) / (F.col("m") * gap)), F.lit(0.0)) for c in ("ix", "iy")}
        pushed = staged(shift.withColumns(push).select(cluster, "t", "seq", "m", "ix", "iy"), "pushed")
        out = decayed_sums(pushed, [cluster], "t", ["seq"], dt, {"vx": F.col("ix"), "vy": F.col("iy")})
        return out.select(F.col(cluster).cast("long").alias(cluster), "t", "seq", F.array(F.col("vx") / F.col("m"), F.col("vy") / F.col("m")).alias("momentum"))

    def step(s, row):
        t, seq, c, x, y = row
        if s:
            gap = t - s["t"]
            m = s["m"] * math.exp(-gap / dt) + 1
            cx, cy = ((m - 1) * s["cx"] + x) / m, ((m - 1) * s["cy"] + y) / m
            ix, iy = ((x - s["cx"]) / (m * gap), (y - s["cy"]) / (m * gap)) if gap else (0.0, 0.0)
            vx, vy = ((m - 1) * s["vx"] + ix) / m, ((m - 1) * s["vy"] + iy) / m
        else:
            m, cx, cy, vx, vy = 1.0, float(x), float(y), 0.0, 0.0
        s.update(t=t, m=m, cx=cx, cy=cy, vx=vx, vy=vy)
        return [(c, t, seq, [vx, vy])]

    return fold(df, [cluster], ["t", "seq"], ["t", "seq", cluster, "x", "y"], f"{cluster} long, t long, seq long, momentum array<double>", lambda key: {}, step)


def momentum_velocity(df: DataFrame, dt: int, cluster: str = "cluster_id") -> DataFrame:
    """The last value of momentum_path up to each time."""
    return _sampled(grid(df, dt, cluster), momentum_path(df, dt, cluster), cluster, "momentum")


def decay_votes_path(df: DataFrame, dt: int, cluster: str = "cluster_id", pol: str = "pol", fold=None) -> DataFrame:
    """(cluster, t, seq, decay_votes) after each event: signed directions that decay with time constant dt, over the
    decayed count. A stream steps through it by a fold."""
    if fold is None:
        sign = lambda a, b: F.when(F.col(pol) == a, 1).when(F.col(pol) == b, -1).otherwise(0)
        out = decayed_sums(df.select(cluster, "t", "seq", pol), [cluster], "t", ["seq"], dt, {"__m": F.lit(1.0), "__u": sign(1, 3), "__v": sign(0, 2)})
        return out.select(F.col(cluster).cast("long").alias(cluster), "t", "seq", F.array(F.col("__u") / F.col("__m"), F.col("__v") / F.col("__m")).alias("decay_votes"))
    unit = {0: (0, 1), 1: (1, 0), 2: (0, -1), 3: (-1, 0)}

    def step(s, row):
        t, seq, c, p = row
        d = math.exp(-(t - s["t"]) / dt) if s else 0.0
        dx, dy = unit.get(p, (0, 0))
        s.update(t=t, m=s.get("m", 0.0) * d + 1, x=s.get("x", 0.0) * d + dx, y=s.get("y", 0.0) * d + dy)
        return [(c, t, seq, [s["x"] / s["m"], s["y"] / s["m"]])]

    return fold(df, [cluster], ["t", "seq"], ["t", "seq", cluster, pol], f"{cluster} long, t long, seq long, decay_votes array<double>", lambda key: {}, step)


def decay_votes_velocity(df: DataFrame, dt: int, cluster: str = "cluster_id", pol: str | None = "pol") -> DataFrame:
    """The last value of decay_votes_path up to each time."""
    g = grid(df, dt, cluster)
    if pol is None:
        return g.select(cluster, "t", F.array(F.lit(NAN), F.lit(NAN)).alias("decay_votes"))
    return _sampled(g, decay_votes_path(df, dt, cluster, pol), cluster, "decay_votes")


def estimate_velocities(df: DataFrame, dt: int = 1000, cluster: str = "cluster_id", pol: str | None = "pol", methods: tuple[str, ...] = METHODS) -> DataFrame:
    """(cluster, t, one array a method); noise is dropped."""
    df = df.where(F.col(cluster) != -1).withColumn(cluster, F.col(cluster).cast("long"))
    one = {"limit": lambda: limit_velocity(df, dt, cluster), "momentum": lambda: momentum_velocity(df, dt, cluster), "votes": lambda: votes_velocity(df, dt, cluster, pol), "decay_votes": lambda: decay_votes_velocity(df, dt, cluster, pol)}
    out = grid(df, dt, cluster).select(cluster, "t")
    for m in methods:
        out = out.join(one[m](), [cluster, "t"])
    return out


def _norm(v: str) -> Column:
    return F.sqrt(F.col(v)[0] * F.col(v)[0] + F.col(v)[1] * F.col(v)[1])


def _angle(a: str, b: str) -> Column:
    dot = (F.col(a)[0] * F.col(b)[0] + F.col(a)[1] * F.col(b)[1]) / (_norm(a) * _norm(b))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))


def _valid(v: str) -> Column:
    return ~(F.isnan(F.col(v)[0]) | F.isnan(F.col(v)[1]))


def angular_error(df: DataFrame, method: str, cluster: str = "cluster_id") -> DataFrame:
    """One row: the mean angle (degrees) to `limit`, over clusters, of clusters with two valid rows or more."""
    both = df.where(_valid("limit") & _valid(method))
    enough = both.groupBy(cluster).agg(F.count("*").alias("n"), F.avg(F.when((_norm("limit") > 1e-6) & (_norm(method) > 1e-6), _angle("limit", method))).alias("e")).where("n >= 2")
    return enough.agg(F.avg("e").alias("angular_error"))


def angular_jitter(df: DataFrame, method: str, cluster: str = "cluster_id") -> DataFrame:
    """One row: the mean angle between consecutive valid rows, over clusters."""
    both = df.where(_valid("limit") & _valid(method))
    w = Window.partitionBy(cluster).orderBy("t")
    pairs = both.withColumns({"__b": F.lag(method).over(w), "__n": F.count("*").over(Window.partitionBy(cluster))}).where("__n >= 2 and __b is not null")
    per = pairs.groupBy(cluster).agg(F.avg(F.when((_norm("__b") > 1e-6) & (_norm(method) > 1e-6), _angle("__b", method))).alias("j"))
    return per.agg(F.avg("j").alias("angular_jitter"))
