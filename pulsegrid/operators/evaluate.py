"""Comparing two labelings of the same rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import staged

METHODS = ("rand", "ari", "nmi", "ami")


def contingency(a: DataFrame, b: DataFrame, la: str, lb: str, on: str = "seq") -> DataFrame:
    """(l1, l2, n): how many rows have each pair of labels; the tables must have the same rows."""
    left, right = a.select(on, F.struct(F.col(la).alias("v")).alias("l1")), b.select(on, F.struct(F.col(lb).alias("v")).alias("l2"))
    counts = staged(left.join(right, on, "full").groupBy("l1", "l2").agg(F.count("*").alias("n")), "contingency")  # a row missing on a side has no struct there
    if not counts.where("l1 is null or l2 is null").isEmpty():
        raise ValueError("the labelings have different rows")
    return counts.select(F.col("l1.v").alias("l1"), F.col("l2.v").alias("l2"), "n")


def _margins(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    return c.groupBy("l1").agg(F.sum("n").cast("double").alias("k")), c.groupBy("l2").agg(F.sum("n").cast("double").alias("k"))


def _sums(c: DataFrame) -> dict[str, float]:
    """Sums over cells and margins, in double precision (products of pair counts exceed longs)."""
    k = F.col("k")
    pair, ent = F.sum(k * (k - 1) / 2), F.sum(k * F.log(k))
    cell = c.select(F.col("n").cast("double").alias("k")).agg(F.sum("k").alias("n"), pair.alias("p"), ent.alias("e"), F.count("*").alias("c")).first()
    a, b = (m.agg(pair.alias("p"), ent.alias("e"), F.count("*").alias("c")).first() for m in _margins(c))
    return {"n": cell["n"] or 0.0, "p": cell["p"] or 0.0, "e": cell["e"] or 0.0, "pa": a["p"] or 0.0, "ea": a["e"] or 0.0, "ca": a["c"], "pb": b["p"] or 0.0, "eb": b["e"] or 0.0, "cb": b["c"]}


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function of whole numbers from 1 on, by Stirling's series from 8 places further up."""
    y = x + 8.0
    up = np.ones_like(y)
    for k in range(8):
        up *= x + k
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(up)


def expected_information(a: float, b: float, n: float) -> float:
    """What two classes of a and b of n rows add to the mutual information by chance: the hypergeometric mean, over all
    counts within 40 standard deviations (beyond, probabilities are below the least double)."""
    spread = 40 * math.sqrt(a * b * (n - a) * (n - b) / max(1.0, n * n * (n - 1))) + 40
    lo, hi = max(1.0, a + b - n, math.floor(a * b / n - spread)), min(a, b, math.ceil(a * b / n + spread))
    k = np.arange(lo, hi + 1)
    fixed = log_gamma(np.array([a + 1, b + 1, n - a + 1, n - b + 1, n + 1])) @ np.array([1, 1, 1, 1, -1])
    p = np.exp(fixed - log_gamma(k + 1) - log_gamma(a - k + 1) - log_gamma(b - k + 1) - log_gamma(n - a - b + k + 1))
    return float((k / n * np.log(n * k / (a * b)) * p).sum())


def expected_mutual_information(sizes_a: dict[int, int], sizes_b: dict[int, int], n: int) -> float:
    """The sum over all pairs of distinct class sizes (and how many classes have each)."""
    return math.fsum(w * v * expected_information(a, b, n) for a, w in sizes_a.items() for b, v in sizes_b.items())


def expected_over_tasks(sizes_a: DataFrame, sizes_b: DataFrame, n: int) -> float:
    """The same of tables (k, w). There are at most sqrt(2 n) sizes on a side: the second side's go along with the tasks of
    the first."""
    other = {r["k"]: r["w"] for r in sizes_b.collect()}

    def work(batches):
        for batch in batches:
            rows = zip(batch.column("k").to_pylist(), batch.column("w").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([expected_mutual_information({k: w}, other, n) for k, w in rows], pa.float64())], ["e"])

    return math.fsum(r["e"] for r in sizes_a.mapInArrow(work, "e double").collect())


def evaluate_clusters(a: DataFrame, b: DataFrame, la: str, lb: str, method: str = "all", on: str = "seq") -> dict[str, float]:
    """rand, ari, nmi, ami, by name; noise counts as a label."""
    if method not in (*METHODS, "all"):
        raise ValueError(f"method must be one of {', '.join(METHODS)}, all")
    c = contingency(a, b, la, lb, on).cache()
    try:
        s = _sums(c)
        n, pairs = s["n"], s["n"] * (s["n"] - 1) / 2
        out: dict[str, float] = {}
        if method in ("rand", "all"):
            out["rand"] = 1.0 if not pairs else (pairs + 2 * s["p"] - s["pa"] - s["pb"]) / pairs
        if method in ("ari", "all"):
            expected = s["pa"] * s["pb"] / pairs if pairs else 0.0
            top = (s["pa"] + s["pb"]) / 2 - expected
            out["ari"] = 1.0 if s["p"] == s["pa"] == s["pb"] else (s["p"] - expected) / top
        if method in ("nmi", "ami", "all"):
            ha, hb = (math.log(n) - e / n if n else 0.0 for e in (s["ea"], s["eb"]))
            mi = max(0.0, ha + hb - (math.log(n) - s["e"] / n)) if n else 0.0
            trivial = s["ca"] == s["cb"] == 1 or not n
            if method in ("nmi", "all"):
                out["nmi"] = 1.0 if trivial else 0.0 if mi <= 1e-15 else mi / ((ha + hb) / 2)
            if method in ("ami", "all"):
                if trivial or s["ca"] == s["cb"] == n:
                    out["ami"] = 1.0
                else:
                    emi = expected_over_tasks(*(m.groupBy("k").agg(F.count("*").alias("w")) for m in _margins(c)), int(n))
                    low = (ha + hb) / 2 - emi
                    out["ami"] = (mi - emi) / (min(low, -2.2e-16) if low < 0 else max(low, 2.2e-16))
        return out
    finally:
        c.unpersist()


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """One row: clusters, noise rows and their share."""
    noise = F.sum((F.col(label) == -1).cast("long"))
    return df.agg(F.countDistinct(F.when(F.col(label) != -1, F.col(label))).alias("clusters"), noise.alias("noise"), (100 * noise / F.count("*")).alias("noise_percent"))
