"""Neighbourhoods on a pixel lattice without pairs.

Events of a cell and its margin are sorted by (pixel, time). What lies within the radius of an event is, for each of the few
pixels around it, one run of that order, whose ends binary search finds; so degrees are differences of places, components of
core events come from one edge a run and one bond a gap inside a run, and no pair of events is ever written."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import idiv

MOST = 1 << 16


def reaches(eps_s: float, eps_t: float, metric: str) -> list[tuple[int, int, int]]:
    """(dx, dy, the longest whole time apart) of the pixels within the radius."""
    r = math.floor(eps_s)
    if metric == "chebyshev":
        return [(dx, dy, math.floor(eps_t)) for dx in range(-r, r + 1) for dy in range(-r, r + 1)]
    if metric != "euclidean":
        raise ValueError("metric must be chebyshev or euclidean")
    rate, out = eps_s / eps_t, []
    for dx in range(-r, r + 1):
        for dy in range(-r, r + 1):
            within = lambda dt: dx * dx + dy * dy + (dt * rate) ** 2 <= eps_s * eps_s  # noqa: B023, E731
            if within(0):
                w = int(math.sqrt(max(0.0, eps_s * eps_s - dx * dx - dy * dy)) / rate)
                while not within(w):
                    w -= 1
                while within(w + 1):
                    w += 1
                out.append((dx, dy, w))
    return out


class Columns:
    """Events in the order of (pixel, time)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, t: np.ndarray, near: list[tuple[int, int, int]]):
        pad, self.wide = max((max(abs(a), abs(b)) for a, b, _ in near), default=0), max((w for _, _, w in near), default=0)
        self.near, self.rows = near, int(y.max() - y.min()) + 1 + 2 * pad
        self.pixel = (x - x.min() + pad) * self.rows + (y - y.min() + pad)
        self.time = t - t.min() + self.wide
        self.span = int(self.time.max()) + self.wide + 1
        key = self.pixel * self.span + self.time
        self.by = np.argsort(key, kind="stable")
        self.key = key[self.by]

    def runs(self, of: np.ndarray, among: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each pixel around: (first, past the last) of what lies near the events `of`, as places in the order, or in the
        order of the events `among` (a mask of places) alone."""
        key = self.key if among is None else self.key[among]
        for dx, dy, w in self.near:
            at = (self.pixel[of] + dx * self.rows + dy) * self.span + self.time[of]
            yield np.searchsorted(key, at - w, "left"), np.searchsorted(key, at + w, "right")


def degree(c: Columns, of: np.ndarray) -> np.ndarray:
    """How many events lie within the radius of each, itself included."""
    out = np.zeros(len(of), np.int64)
    for lo, hi in c.runs(of):
        out += hi - lo
    return out


def core_roots(c: Columns, core: np.ndarray) -> np.ndarray:
    """For each core event (a mask of events) the least event of its component; others stand for themselves."""
    among = core[c.by]
    events = c.by[among]  # core events in the order
    n, u, v, bond = len(events), [], [], np.zeros(len(events) + 1, np.int64)
    for lo, hi in c.runs(events, among):
        some = np.flatnonzero(hi > lo)
        u.append(events[some])
        v.append(events[lo[some]])
        np.add.at(bond, lo[some], 1)
        np.add.at(bond, hi[some] - 1, -1)
    tied = np.flatnonzero(np.cumsum(bond)[: max(0, n - 1)] > 0)
    u, v = np.concatenate([*u, events[tied]]), np.concatenate([*v, events[tied + 1]])
    root = np.arange(len(core))
    while len(u):
        ru, rv = root[u], root[v]
        apart = ru != rv
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(ru, rv)[apart], np.minimum(ru, rv)[apart])
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def lowest(c: Columns, of: np.ndarray, core: np.ndarray, label: np.ndarray, none: int) -> np.ndarray:
    """The least label of the core events within the radius of each event."""
    among = core[c.by]
    own, out = label[c.by[among]], np.full(len(of), none)
    for lo, hi in c.runs(of, among):
        some = np.flatnonzero(hi > lo)
        ends = np.stack((lo[some], np.minimum(hi[some], len(own) - 1)), 1).ravel()
        if len(ends):  # a run that ends with the order is cut one short by reduceat's ends, so its last one is looked at apart
            least = np.minimum.reduceat(own, ends)[::2]
            out[some] = np.minimum(out[some], np.minimum(least, own[hi[some] - 1]))
    return out


# --- over a recording ------------------------------------------------------------------------------------------------

_CELL = ("cx", "cy", "ct")


def spread(df: DataFrame, side: int, span: int, margin: int, wait: int) -> DataFrame:
    """Each event in its cell (side x side pixels, span of time) and in all whose margin holds it; `own` tells which."""
    for c, size, reach in (("x", side, margin), ("y", side, margin), ("t", span, wait)):
        df = df.withColumn(f"o{c}", idiv(c, size)).withColumn(f"c{c}", F.explode(F.sequence(idiv(F.col(c) - reach, size), idiv(F.col(c) + reach, size))))
    own = (F.col("ox") == F.col("cx")) & (F.col("oy") == F.col("cy")) & (F.col("ot") == F.col("ct"))
    return df.withColumn("own", own).drop("ox", "oy", "ot")


def cell_size(df: DataFrame, eps_s: float, eps_t: float, most: int = MOST) -> tuple[int, int, int, int]:
    """(side, span, margin, wait) of the cells: the span of time is halved while the fullest cell has more than `most` events,
    down to the radius."""
    margin, wait = math.floor(eps_s), math.floor(eps_t)
    side, span = max(16, 8 * margin), max(1, 8 * wait)
    while span > max(1, wait) and (df.groupBy(idiv("x", side), idiv("y", side), idiv("t", span)).count().agg(F.max("count")).first()[0] or 0) > most:
        span = max(1, span // 2)
    return side, span, margin, wait


def _read(table: pa.Table, near: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, Columns]:
    seq, x, y, t = (table.column(n).to_numpy().astype(np.int64) for n in ("seq", "x", "y", "t"))
    return seq, table.column("own").to_numpy(zero_copy_only=False), Columns(x, y, t, near)


def degrees(df: DataFrame, eps_s: float, eps_t: float, metric: str, size: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(seq, degree) of every event."""
    near = reaches(eps_s, eps_t, metric)

    def run(table: pa.Table) -> pa.Table:
        seq, own, c = _read(table, near)
        of = np.flatnonzero(own)
        return pa.table({"seq": seq[of], "degree": degree(c, of)})

    cells = spread(df.select("seq", "x", "y", "t"), *(size or cell_size(df, eps_s, eps_t)))
    return cells.groupBy(*_CELL).applyInArrow(run, "seq long, degree long")


def core_links(core: DataFrame, eps_s: float, eps_t: float, metric: str, size: tuple[int, int, int, int]) -> DataFrame:
    """(a, b, own). Where own: core event b and the least event a of its component among its cell's events. Else links
    between such components, whose number goes with them and not with the events.

    A strip, the events of one cell that a neighbour sees, is cut into components by both cells alike, and these are known
    by their least events; one tells which of its own components they belong to, the other what they touch there."""
    near = reaches(eps_s, eps_t, metric)
    side, span, margin, wait = size
    axes = (("x", side, margin), ("y", side, margin), ("t", span, wait))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        seq, own, c = _read(table, near)
        n, here = len(seq), [table.column(k)[0].as_py() for k in _CELL]
        at = {k: table.column(k).to_numpy().astype(np.int64) for k in ("x", "y", "t")}

        def roots(of: np.ndarray) -> np.ndarray:
            return of[core_roots(Columns(*(v[of] for v in at.values()), near), np.ones(len(of), bool))]

        whole, part = core_roots(c, np.ones(n, bool)), np.arange(n)
        _, home = np.unique(np.stack([at[k] // step for k, step, _ in axes], 1), axis=0, return_inverse=True)
        for h in range(home.max() + 1):
            of = np.flatnonzero(home == h)
            part[of] = roots(of)
        mine = np.flatnonzero(own)
        touched = np.zeros(n, bool)
        touched[whole[mine]] = True
        heads = np.flatnonzero(touched[whole] & (part == np.arange(n)))
        least = np.full(n, n)
        np.minimum.at(least, whole[heads], heads)
        a, b = [least[whole[heads]]], [heads]
        for step in itertools.product((-1, 0, 1), repeat=3):
            seen = np.ones(len(mine), bool)
            for (k, length, reach), cell, d in zip(axes, here, step, strict=True):
                seen &= ((at[k][mine] - reach) // length <= cell + d) & ((at[k][mine] + reach) // length >= cell + d)
            of = mine[seen]
            if 0 < len(of) < len(mine):
                of = np.unique(roots(of))
                a.append(part[of])
                b.append(of)
        a, b = np.concatenate(a), np.concatenate(b)
        tied = a != b
        links = np.zeros(len(mine) + int(tied.sum()), bool)
        links[: len(mine)] = True
        return pa.table({"a": seq[np.concatenate([part[mine], a[tied]])], "b": seq[np.concatenate([mine, b[tied]])], "own": links})

    return spread(core.select("seq", "x", "y", "t"), *size).groupBy(*_CELL).applyInArrow(run, "a long, b long, own boolean")


def border_labels(df: DataFrame, eps_s: float, eps_t: float, metric: str, size: tuple[int, int, int, int]) -> DataFrame:
    """(seq, c): for events without c the least c of those within the radius that have one, if there are any."""
    near = reaches(eps_s, eps_t, metric)
    none = np.iinfo(np.int64).max

    def run(table: pa.Table) -> pa.Table:
        seq, own, c = _read(table, near)
        label = table.column("c").fill_null(none).to_numpy().astype(np.int64)
        core = label < none
        of = np.flatnonzero(own & ~core)
        got = lowest(c, of, core, label, none) if core.any() else np.full(len(of), none)
        return pa.table({"seq": seq[of[got < none]], "c": got[got < none]})

    return spread(df.select("seq", "x", "y", "t", F.col("c").cast("long").alias("c")), *size).groupBy(*_CELL).applyInArrow(run, "seq long, c long")
