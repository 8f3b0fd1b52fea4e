"""Document fingerprints: closed syncmers.

A k-mer of code points is an anchor when the least hash among its s-mers lies at its first or last place. That depends
on the k-mer alone, so an edit moves no anchor outside the k-mers it touches. The fingerprint holds the anchors with their
places, all of them whatever the length: nothing is sampled, so likeness is exact for texts of any length. Two texts are compared
by the anchors both hold, at one common shift, among all anchors of either.

Defined results: null text is empty; a text shorter than k has one anchor, its whole; the empty text has none, and two
empty texts are alike (1.0), an empty and another are not (0.0). Equal texts have equal fingerprints. Rows that repeat
are fingerprinted each. A null doc_id sorts first. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, slices, text_rows

K, S, SLACK = 12, 5, 64
ALL, QUARTER = 0xFFFFFFFF, 0x3FFFFFFF
WHOLE = math.inf  # texts of up to so many anchors are held whole
Sketch = tuple[np.ndarray, np.ndarray, int]
_M = np.uint32(0x9E3779B1)
NULL_ID = -(2**63)


def _scramble(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def syncmers(c: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the closed syncmers."""
    n = len(c)
    if n < k:
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        h = np.uint32(n)
        for x in c.tolist():
            h = np.uint32((int(h) * int(_M) + x) & 0xFFFFFFFF)
        return np.zeros(1, np.int64), _scramble(np.array([h], np.uint32))
    m = n - s + 1
    h = c[:m] * _M
    for j in range(1, s):
        h += c[j : j + m]
        h *= _M
    h = _scramble(h)
    w = k - s + 1
    least, reach = h, 1
    while reach * 2 <= w:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < w:
        least = np.minimum(least[: len(least) - (w - reach)], least[w - reach :])
    at = np.flatnonzero((least == h[: n - k + 1]) | (least == h[w - 1 :]))
    g = c[at] * _M
    for j in range(1, k):
        g += c[at + j]
        g *= _M
    return at, _scramble(g)


def sketch(text: str, k: int = K, s: int = S) -> Sketch:
    """(hashes ascending, places, highest hash held, which is the highest there is): each anchor at its first place."""
    at, h = syncmers(code_points(text), k, s)
    u, i = np.unique(h, return_index=True)
    return u, at[i], ALL


def spell(sk: Sketch) -> str:
    return base64.b64encode(np.array([sk[2]], "<u4").tobytes() + sk[0].astype("<u4").tobytes() + sk[1].astype("<u4").tobytes()).decode()


def read(fingerprint: str) -> Sketch:
    v = np.frombuffer(base64.b64decode(fingerprint), "<u4")
    n = len(v) // 2
    return v[1 : n + 1], v[n + 1 :].astype(np.int64), int(v[0])


def likeness(a: Sketch, b: Sketch, slack: int = SLACK) -> float:
    """Anchors of both, at the most usual shift (within the slack), as a share of all anchors of either."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    limit = np.uint32(min(a[2], b[2]))
    (x, px), (y, py) = ((v[0][: (n := int(np.searchsorted(v[0], limit, "right")))], v[1][:n]) for v in (a, b))
    shared, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    shift = np.sort(px[i] - py[j])
    run = np.searchsorted(shift, shift + slack, "right") - np.arange(len(shift))
    return float(run.max()) / (len(x) + len(y) - len(shared))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every whole text."""

    def work(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([spell(sketch(t)) for t in texts], pa.string())],
                ["doc_id", "n_chars", "fingerprint"],
            )

    return text_rows(docs).mapInArrow(work, "doc_id long, n_chars long, fingerprint string")


def edited(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Each document beside its edit by the next one (by doc_id; repeated ids by text; after the last the first).

    The texts are shuffled once, into ranges of doc_id of about equal size (bounds from approximate quantiles of the
    ids); the first document of each range is also sent to the end of the range before it, so each range knows the
    successor of its last one. Only range bounds and one id a range reach the driver. A sorted range is streamed.
    """
    spark = docs.sparkSession
    rows = text_rows(docs).withColumn("k", F.coalesce("doc_id", F.lit(NULL_ID)))
    parts = shuffle_partitions(spark)
    ids = rows.select(F.col("k").cast("double").alias("kd"))
    n = 4 * parts
    cuts = sorted(set(ids.approxQuantile("kd", [i / n for i in range(1, n)], 0.25 / n)))
    if cuts:
        deal = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="kd", outputCol="b")
        rows = deal.transform(rows.withColumn("kd", F.col("k").cast("double"))).withColumn("b", F.col("b").cast("int")).drop("kd")
    else:
        rows = rows.withColumn("b", F.lit(0))
    heads = sorted((r["b"], r["k"]) for r in rows.groupBy("b").agg(F.min("k").alias("k")).collect())
    if not heads:
        return spark.createDataFrame([], EDIT_SCHEMA)
    before = {k: heads[i - 1][0] for i, (_, k) in enumerate(heads)}
    marks = spark.createDataFrame([(k, b) for k, b in before.items()], "k long, b int")  # one row a range
    tails = rows.drop("b").join(F.broadcast(marks), "k").select("doc_id", "text", "k", "b", F.lit(True).alias("tail"))
    dealt = rows.withColumn("tail", F.lit(False)).select("doc_id", "text", "k", "b", "tail").unionByName(tails)
    dealt = dealt.repartition(parts, "b").sortWithinPartitions("b", "tail", "k", "text")

    def work(batches):
        held = None  # the document that waits for its successor
        for batch in slices(batches):
            out = []
            for d, t, b, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "b", "tail")), strict=True):
                own = None
                if held is not None and held[2] == b:
                    own = sketch(t)
                    e = edited(held[1], t)
                    se = sketch(e)
                    out.append((held[0], len(held[1]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), spell(held[3]), spell(se), likeness(held[3], se), likeness(held[3], own)))
                held = None if tail else (d, t, b, own if own is not None else sketch(t))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], EDIT_NAMES)

    return dealt.mapInArrow(work, EDIT_SCHEMA)


EDIT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
EDIT_NAMES = [c.split()[0] for c in EDIT_SCHEMA.split(", ")]
