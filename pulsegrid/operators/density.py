"""Spatio-temporal DBSCAN, windowed clustering with stitching, cluster summaries."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import idiv
from ..model import NOISE, with_position
from ..plans.staging import discard, staged
from . import columns
from .components import connected_components


def stdbscan(df: DataFrame, eps_s: float = 2, eps_t: float = 1e4, min_pts: int = 10, metric: str = "chebyshev", label: str = "cluster", chunk: int | None = None, overlap: int | None = None, **guards) -> DataFrame:
    """df with `label`: clusters numbered by their least core row, -1 noise; a border row takes the lowest-numbered
    cluster among its core neighbours. With `chunk`, count windows are clustered apart and stitched."""
    if chunk is not None:
        fit = lambda pdf: local_dbscan(pdf, eps_s, eps_t, min_pts, metric)
        return chunked(df, fit, chunk, chunk // 5 if overlap is None else overlap, label, **guards)
    if metric == "chebyshev":
        return _by_boxes(df, eps_s, eps_t, min_pts, label)
    return _by_columns(df, eps_s, eps_t, min_pts, metric, label)


ROWS = 250_000


def _dealt(df: DataFrame, rows: int) -> DataFrame:
    """df by seq, ROWS of all rows a task: what is dealt by bytes holds as many ids as compress into them."""
    return df.repartition(1 + rows // ROWS, "seq")


def _labelled(df: DataFrame, found: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    rows = df.count() if rows is None else rows
    return _dealt(df, rows).join(_dealt(found, rows), "seq", "left").na.fill(NOISE, [label])


def _by_columns(df: DataFrame, eps_s: float, eps_t: float, min_pts: int, metric: str, label: str) -> DataFrame:
    """By runs of time-sorted pixels in cells (see columns.py): degrees, links of core events, labels of border events."""
    size = columns.cell_size(df, eps_s, eps_t)
    thin = df.select("seq", "x", "y", "t")
    rows = df.count()
    dense = columns.degrees(thin, eps_s, eps_t, metric, size).where(F.col("degree") >= min_pts).select("seq")
    core = staged(_dealt(thin, rows).join(_dealt(dense, rows), "seq", "left_semi"), "core")
    links = staged(columns.core_links(core, eps_s, eps_t, metric, size), "links")
    roots = connected_components(links.where("not own"), staged, "a", "b", discard).withColumnRenamed("node", "a")
    rooted = staged(links.where("own").join(roots, "a", "left").select(F.col("b").alias("seq"), F.coalesce("root", "a").alias("root")), "roots")
    discard(core, links)
    named = staged(number(rooted.select("root").distinct(), "root", "c").join(rooted, "root").select("seq", "c"), "named")
    border = columns.border_labels(_dealt(thin, rows).join(_dealt(named, rows), "seq", "left"), eps_s, eps_t, metric, size)
    found = named.unionByName(border).select("seq", F.col("c").cast("int").alias(label))
    return _labelled(df, found, label, rows)


BOX = ("bx", "by", "bt")


def _around(df: DataFrame) -> DataFrame:
    """A copy of each row for each of the 27 boxes at and around its own; `later` is the step in time."""
    for k in BOX[:2]:
        df = df.withColumn(k, F.explode(F.array(F.col(k) - 1, F.col(k), F.col(k) + 1)))
    steps = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    return df.withColumn("later", F.explode(steps)).withColumn("bt", F.col("bt") + F.col("later"))


def _by_boxes(df: DataFrame, eps_s: float, eps_t: float, min_pts: int, label: str) -> DataFrame:
    """stdbscan under the Chebyshev metric without neighbour pairs. Events of a box no larger than the radius are all
    neighbours, and all others lie in the 26 boxes around. So a box of min_pts events is core at once, only events of thinner
    boxes (fewer than min_pts each) count theirs; and of a box's cores on one pixel only the first and the last in time can
    be nearest to another box. Clusters are components of boxes."""
    side, span = int(eps_s) + 1, int(eps_t) + 1
    box = [idiv("x", side).alias("bx"), idiv("y", side).alias("by"), idiv("t", span).alias("bt")]
    placed = staged(df.select("seq", "x", "y", "t", *box), "placed")
    sized = placed.join(placed.groupBy(*BOX).agg(F.count("*").alias("n")), list(BOX))
    thin = staged(sized.where(F.col("n") < min_pts).drop("n"), "thin")
    close = (F.abs(F.col("x") - F.col("x2")) <= eps_s) & (F.abs(F.col("y") - F.col("y2")) <= eps_s)
    other = placed.select(*BOX, F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("t").alias("t2"))
    counted = _around(thin).join(other, list(BOX)).where(close & (F.abs(F.col("t") - F.col("t2")) <= eps_t)).groupBy("seq").agg(F.count("*").alias("n"))
    counted = staged(counted.where(F.col("n") >= min_pts).select("seq"), "counted")
    core = staged(sized.where(F.col("n") >= min_pts).drop("n").unionByName(thin.join(counted, "seq", "left_semi")), "core")
    columns = core.groupBy(*BOX, "x", "y").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    reps = core.groupBy(*BOX).agg(F.min("seq").alias("rep"))
    columns = staged(columns.join(reps, list(BOX)), "columns")
    other = columns.select(*BOX, F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("rep").alias("rep2"))
    near = lambda lo, hi: F.when(F.col("later") == 0, True).when(F.col("later") > 0, F.col("lo2") - hi <= eps_t).otherwise(lo - F.col("hi2") <= eps_t)
    links = _around(columns).join(other, list(BOX)).where(close & (F.col("rep") < F.col("rep2")) & near(F.col("lo"), F.col("hi"))).select("rep", "rep2").distinct()
    roots = reps.join(connected_components(links, staged, "rep", "rep2", discard).withColumnRenamed("node", "rep"), "rep", "left").select(*BOX, F.coalesce("root", "rep").alias("root"))
    roots = staged(roots, "roots")
    named = staged(number(roots.select("root").distinct(), "root", "c").join(roots, "root").select(*BOX, F.col("c").cast("int").alias("c")), "named")
    own = core.join(named, list(BOX)).select("seq", F.col("c").alias(label))
    border = _around(thin.join(counted, "seq", "left_anti")).join(other.drop("rep2").join(named, list(BOX)), list(BOX)).where(close & near(F.col("t"), F.col("t")))
    found = own.unionByName(border.groupBy("seq").agg(F.min("c").alias(label)))
    return _labelled(df, found, label)


def number(df: DataFrame, key: str, name: str) -> DataFrame:
    """The rows of df (distinct keys) numbered from 0 in ascending order, without a single-partition sort."""
    return with_position(df, key, name=name)


def degrees(df: DataFrame, eps_s: float, eps_t: float, metric: str = "chebyshev") -> DataFrame:
    return columns.degrees(df, eps_s, eps_t, metric)


def local_dbscan(pdf: pd.DataFrame, eps_s: float, eps_t: float, min_pts: int, metric: str = "chebyshev") -> np.ndarray:
    """DBSCAN of one window, rows in order of (t, seq): clusters by their least core row, border rows the lowest they touch."""
    if not len(pdf):
        return np.zeros(0, np.int64)
    x, y, t = (pdf[c].to_numpy(np.int64) for c in ("x", "y", "t"))
    c, every = columns.Columns(x, y, t, columns.reaches(eps_s, eps_t, metric)), np.arange(len(pdf))
    core, label = columns.degree(c, every) >= min_pts, np.full(len(pdf), NOISE)
    if core.any():
        root = columns.core_roots(c, core)
        label[core] = np.unique(root[core], return_inverse=True)[1]
        got = columns.lowest(c, every[~core], core, label, len(pdf))
        label[~core] = np.where(got < len(pdf), got, NOISE)
    return label


def chunked(df: DataFrame, fit: Callable[[pd.DataFrame], np.ndarray], chunk: int, overlap: int, label: str = "cluster", min_overlap_frac: float = 0.0, max_centroid_dist: float = math.inf) -> DataFrame:
    """Clusters count windows [i stride, i stride + chunk) apart by fit(rows in order) and unites labels of neighbouring
    windows that share rows of their overlap (guarded by their share and the distance of centroids there). A row's label
    comes from the window whose first `stride` rows hold it. A group is one window, so it is bounded by `chunk`."""
    stride = chunk - overlap
    if stride <= 0:
        raise ValueError("overlap must be smaller than chunk")
    placed = staged(with_position(df), "placed")
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - chunk + 1) / stride)).cast("long")
    windows = placed.select("pos", "seq", "t", "x", "y", F.explode(F.sequence(first, F.floor(F.col("pos") / stride))).alias("w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        return pd.DataFrame({"w": pdf["w"], "pos": pdf["pos"], "x": pdf["x"], "y": pdf["y"], "local": np.asarray(fit(pdf), np.int64)})

    found = staged(windows.groupBy("w").applyInPandas(run, "w long, pos long, x int, y int, local long"), "windows")
    a = found.where("local >= 0").select("pos", "w", F.col("local").alias("la"), "x", "y")
    b = found.where("local >= 0").select("pos", (F.col("w") - 1).alias("w"), F.col("local").alias("lb"))
    # The overlap of windows w and w + 1: rows of both.
    tail = a.where(F.col("pos") >= (F.col("w") + 1) * stride)
    head = found.where("local >= 0").where(F.col("pos") < F.col("w") * stride + overlap).where("w > 0")
    pairs = tail.join(b, ["pos", "w"]).groupBy("w", "la", "lb").agg(F.count("*").alias("n"))
    if min_overlap_frac > 0 or math.isfinite(max_centroid_dist):
        ta = tail.groupBy("w", "la").agg(F.count("*").alias("na"), F.avg("x").alias("xa"), F.avg("y").alias("ya"))
        hb = head.groupBy((F.col("w") - 1).alias("w"), F.col("local").alias("lb")).agg(F.count("*").alias("nb"), F.avg("x").alias("xb"), F.avg("y").alias("yb"))
        pairs = pairs.join(ta, ["w", "la"]).join(hb, ["w", "lb"]).where(F.col("n") / F.least("na", "nb") >= min_overlap_frac)
        pairs = pairs.where(F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")) <= max_centroid_dist)
    # A window has fewer than `chunk` labels, so w * chunk + local names one.
    edges = pairs.select((F.col("w") * chunk + F.col("la")).alias("a"), ((F.col("w") + 1) * chunk + F.col("lb")).alias("b"))
    roots = connected_components(edges, staged)
    own = found.where(F.floor(F.col("pos") / stride) == F.col("w")).select("pos", "local", (F.col("w") * chunk + F.col("local")).alias("node"))
    named = own.where("local >= 0").join(roots, "node", "left").select("pos", F.coalesce("root", "node").alias("root"))
    ids = number(named.select("root").distinct(), "root", "__c")
    labels = named.join(ids, "root").select("pos", F.col("__c").cast("int").alias(label))
    return placed.join(labels, "pos", "left").na.fill(NOISE, [label]).drop("pos")


def cluster_summary(df: DataFrame, label: str = "cluster") -> DataFrame:
    """One row a label, noise included."""
    ends = [f(c).alias(f"{c}_{n}") for c in ("x", "y", "t") for n, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(label).agg(F.count("*").alias("n_events"), *ends, (F.max("t") - F.min("t")).alias("t_span"))
