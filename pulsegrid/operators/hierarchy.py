"""Hierarchical density clustering of a whole recording, as Spark jobs.

The labels are those of one hierarchy over all events (hdbscan.local_hdbscan defines them); no window takes part.

1. Core distances. A grid with cells of side S deals out the events; a cell also sees what lies within R = S / 4 around it, so
   every k-th neighbour within R is exact. Events with a further one go on with S and R doubled; they are few, and the cells
   near them are split by salt, each part sending its k nearest.
2. Candidate edges. In each cell and its margin the spanning forest of mutual-reachability edges up to R holds all edges of
   the whole spanning tree that are as short (a heaviest edge of a cycle is in no least tree). Then R doubles until one
   component is left: boxes of (cell, component) within R of each other are paired, pairs whose distance exceeds what one
   pair of events of the same two components shows to be possible are dropped, and the rest give their lightest edge.
3. Single linkage. Edges are split at their median: the components of the light half are pieces of their own, the heavy half
   sees each of them as one node (an edge inside one closes a cycle and goes). Halving goes on until no piece has more than
   PIECE edges; each is then folded by itself, into clusters, what falls out of them, and splits.
4. The condensed tree is a table; stabilities are sums by cluster. Clusters are chosen from the leaves up: while more than
   PIECE are left, all whose children are settled are settled together, by a join.

Edges are ordered by (weight, least row, greatest row), rows by (t, seq), so ties have one outcome.

Groups are bounded by CELL, PIECE, SMALL (edges of a graph whose components one task finds at once) and PAIRS (pairs of boxes that one call takes) whatever the data: cells are halved until the fullest has at most 4 CELL events, and of
more than k + 1 events at one and the same place only the first k + 1 take part in core distances and the first alone in edges: their
own core distance is 0, the others follow the first at weight 0, and any edge to the place is least at its first row. Such a
place is a piece that is known without folding it (see _places).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import NOISE, with_position
from ..plans.staging import discard, staged
from .components import contracted_components
from .hdbscan import along, short_forest

CELL, PIECE, SALT, SMALL, PAIRS = 512, 1 << 18, 1 << 15, 1 << 20, 256
_POINT = ("row", "x", "y", "t")


def _array(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _cells(df: DataFrame, side: float, names: tuple[str, str, str] = ("cx", "cy", "ct")) -> DataFrame:
    return df.select("*", *(F.floor(F.col(c) / side).cast("long").alias(n) for c, n in zip("xyt", names, strict=True)))


def _spread(df: DataFrame, side: float, margin: float) -> DataFrame:
    """Each event in its own cell and in all whose margin holds it (at most eight)."""
    own = _cells(df, side, ("ox", "oy", "ot"))
    for c, n in zip("xyt", ("cx", "cy", "ct"), strict=True):
        reach = F.sequence(F.floor((F.col(c) - margin) / side).cast("long"), F.floor((F.col(c) + margin) / side).cast("long"))
        own = own.withColumn(n, F.explode(reach))
    return own.withColumn("own", (F.col("cx") == F.col("ox")) & (F.col("cy") == F.col("oy")) & (F.col("ct") == F.col("ot"))).drop("ox", "oy", "ot")


def _squares(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    dx, dy, dt = (q[:, None, i] - x[None, :, i] for i in range(3))
    return dx * dx + dy * dy + dt * dt


# --- 1. core distances -----------------------------------------------------------------------------------------------


def _near(k: int, radius: float):
    """The core distance of a cell's own events, null where it exceeds the radius."""

    def run(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy(zero_copy_only=False)
        row, *xyt = _array(table, *_POINT)
        x = np.stack(xyt, 1)
        by, behind = along(x, radius)
        row, own, x = row[by], own[by], x[by]
        at, out = np.flatnonzero(own), np.full(int(own.sum()), np.inf)
        # Only what lies within the radius on the axis, before and behind: all that counts.
        last = np.arange(len(x)) + behind
        first = np.searchsorted(last, np.arange(len(x)))
        for lo in range(0, len(at), 128):
            some = at[lo : lo + 128]
            near = x[first[some[0]] : last[some[-1]] + 1]
            if len(near) > k:
                out[lo : lo + 128] = np.sqrt(np.partition(_squares(near, x[some]), k, axis=1)[:, k])
        return pa.table({"row": row[own], "core": pa.array(out, mask=~(out <= radius))})

    return run


def _nearest_of(k: int, radius: float):
    """For the events asked for: the squared distances within the radius to at most k + 1 of one part of a cell's events."""

    def run(asked: pa.Table, seen: pa.Table) -> pa.Table:
        (row, *qs), xs = _array(asked, *_POINT), _array(seen, "nx", "ny", "nt")
        q, x, lists = np.stack(qs, 1), np.stack(xs, 1), []
        if len(x):
            for lo in range(0, len(q), 64):
                d = _squares(x, q[lo : lo + 64])
                d = np.sort(np.partition(d, k, axis=1)[:, : k + 1] if d.shape[1] > k + 1 else d, axis=1)
                lists += [r[r <= radius * radius * (1 + 1e-9)] for r in d]
        lists = lists or [np.zeros(0)] * len(q)
        return pa.table({"row": row, "near": pa.array(lists, pa.list_(pa.float64()))})

    return run


def core_distances(points: DataFrame, k: int, side: float, limit: float, of: DataFrame | None = None) -> DataFrame:
    """(row, core): the distance to the k-th nearest other event, of all events or of the rows `of`. limit: no two events are further apart."""
    radius = side / 4
    seen = _spread(points, side, radius)
    if of is not None:  # only the cells of what is asked for
        seen = seen.join(of.withColumn("asked", F.lit(True)), "row", "left").withColumn("own", F.col("own") & F.col("asked").isNotNull()).drop("asked")
        at = ["cx", "cy", "ct"]
        seen = seen.join(seen.where("own").select(*at).distinct(), at, "left_semi").select(*_POINT, *at, "own")
    found = staged(seen.groupBy("cx", "cy", "ct").applyInArrow(_near(k, radius), "row long, core double"), "core")
    parts, waiting = [found.where("core is not null")], staged(points.join(found.where("core is null").select("row"), "row", "left_semi"), "waiting")
    while waiting.count():
        side, radius = 2 * side, 2 * radius
        asked = _cells(waiting, side)
        at = ["cx", "cy", "ct"]
        near = _spread(points, side, radius).select(*_POINT, *at).join(asked.select(*at).distinct(), at, "left_semi")
        salts = near.groupBy(*at).agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
        salted = near.join(salts, at).withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("long")).drop("salts")
        copies = asked.join(salts, at).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1))).drop("salts")
        lists = copies.groupBy(*at, "salt").cogroup(salted.select(*(F.col(c).alias(f"n{c}") for c in salted.columns)).groupBy(*(f"n{c}" for c in at), "nsalt")).applyInArrow(_nearest_of(k, radius), "row long, near array<double>")
        kth = F.sort_array(F.flatten(F.collect_list("near")))
        got = staged(lists.groupBy("row").agg(F.sqrt(F.try_element_at(kth, F.lit(k + 1))).alias("core")), "core")
        done = got.where((F.col("core") <= radius) | F.lit(radius > limit) & F.col("core").isNotNull())
        parts.append(done)
        waiting = staged(waiting.join(done, "row", "left_anti"), "waiting")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- 2. candidate edges ----------------------------------------------------------------------------------------------


def _forest(radius: float):
    """The least spanning forest of a cell and its margin by edges up to the radius: those whose least end is the cell's.
    Rows marked link tell the same components in fewer steps: each of the cell's events with the least row of its component
    here (w is null), and the edges that leave the cell."""

    def run(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy(zero_copy_only=False)
        row, *xyt, core = _array(table, *_POINT, "core")
        by = np.argsort(row)
        row, own, core, x = row[by], own[by], core[by], np.stack(xyt, 1)[by]
        a, b, w = short_forest(x, core, radius) if own.any() and len(row) > 1 else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        root = np.arange(len(row))
        u, v = a, b
        while len(u):  # the larger root follows the smaller one
            ru, rv = root[u], root[v]
            apart = ru != rv
            u, v = u[apart], v[apart]
            np.minimum.at(root, np.maximum(ru, rv)[apart], np.minimum(ru, rv)[apart])
            while not np.array_equal(up := root[root], root):
                root = up
        kept, star = own[a], np.flatnonzero(own & (root != np.arange(len(row))))
        return pa.table({
            "a": np.concatenate((row[a[kept]], row[root[star]])), "b": np.concatenate((row[b[kept]], row[star])),
            "w": pa.array(np.concatenate((w[kept], np.zeros(len(star)))), mask=np.arange(int(kept.sum()) + len(star)) >= int(kept.sum())), "link": np.concatenate((~own[b[kept]], np.ones(len(star), bool))),
        })

    return run


def _from_box(x: np.ndarray, core: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The least weight that an edge from each event to the box of the other events can have."""
    gap = np.maximum(np.maximum(other.min(0) - x, x - other.max(0)), 0)
    return np.maximum(np.sqrt((gap * gap).sum(1)), core)


def _lightest(ra: np.ndarray, xa: np.ndarray, ca: np.ndarray, rb: np.ndarray, xb: np.ndarray, cb: np.ndarray) -> tuple[float, int, int]:
    """The lightest mutual-reachability edge between two boxes of events. In large ones, what is further from the other box than some
    edge shows to be possible is left out first."""
    if len(ra) * len(rb) > 4096:
        far_a, far_b = _from_box(xa, ca, xb), _from_box(xb, cb, xa)
        i, j = far_a.argmin(), far_b.argmin()
        shown = min(np.maximum(np.maximum(np.sqrt(_squares(xb, xa[i : i + 1])[0]), cb), ca[i]).min(), np.maximum(np.maximum(np.sqrt(_squares(xa, xb[j : j + 1])[0]), ca), cb[j]).min()) * (1 + 1e-9)
        a, b = far_a <= shown, far_b <= shown
        ra, xa, ca, rb, xb, cb = ra[a], xa[a], ca[a], rb[b], xb[b], cb[b]
    best = None
    for lo in range(0, len(ra), 256):
        w = np.maximum(np.maximum(np.sqrt(_squares(xb, xa[lo : lo + 256])), cb[None, :]), ca[lo : lo + 256, None])
        i, j = np.nonzero(w == w.min())
        p, q = ra[lo + i], rb[j]
        lows, highs = np.minimum(p, q), np.maximum(p, q)
        low = lows.min()
        here = (float(w.min()), int(low), int(highs[lows == low].min()))
        best = here if best is None else min(best, here)
    return best


def _all_lightest(left: pa.Table, right: pa.Table) -> pa.Table:
    """The lightest edge of each pair of boxes in a group of pairs."""
    (pair, ca, cb, row, *xyt, core), (pair2, row2, *xyt2, core2) = _array(left, "pair", "ca", "cb", *_POINT, "core"), _array(right, *(f"{c}2" for c in ("pair", *_POINT, "core")))
    by, by2 = np.argsort(pair, kind="stable"), np.argsort(pair2, kind="stable")
    row, x, core, row2, x2, core2 = row[by], np.stack(xyt, 1)[by], core[by], row2[by2], np.stack(xyt2, 1)[by2], core2[by2]
    pairs, first = np.unique(pair[by], return_index=True)
    ends, ends2 = np.append(first, len(by)), np.append(np.searchsorted(pair2[by2], pairs), len(by2))
    best = [_lightest(row[i:j], x[i:j], core[i:j], row2[k:m], x2[k:m], core2[k:m]) for i, j, k, m in zip(ends, ends[1:], ends2, ends2[1:], strict=False)]
    w, a, b = zip(*best, strict=True)
    return pa.table({"ca": ca[by][first], "cb": cb[by][first], "w": pa.array(w, pa.float64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _apart(low: str = "", high: str = "2") -> Column:
    """The least distance that two boxes and their least cores allow."""
    gaps = [F.greatest(F.lit(0.0), F.col(f"{c}0{high}") - F.col(f"{c}1{low}"), F.col(f"{c}0{low}") - F.col(f"{c}1{high}")) for c in "xyt"]
    return F.greatest(F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])), F.col(f"least{low}"), F.col(f"least{high}"))


def _shown() -> Column:
    """The weight of the edge between the two boxes' events of least core distance."""
    d = [F.col(f"rep.{c}") - F.col(f"rep2.{c}") for c in "xyt"]
    return F.greatest(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]), "least", "least2")


def _boxes(df: DataFrame, *keys: str) -> DataFrame:
    ends = [f(c).alias(f"{c}{i}") for c in "xyt" for i, f in enumerate((F.min, F.max))]
    return df.groupBy(*keys).agg(*ends, F.min("core").alias("least"), F.min_by(F.struct("x", "y", "t"), F.struct("core", "row")).alias("rep"))


def _second(df: DataFrame, *kept: str) -> DataFrame:
    return df.select(*(F.col(c).alias(c if c in kept else f"{c}2") for c in df.columns))


def _promising(pairs: DataFrame, radius: float) -> DataFrame:
    """Pairs of boxes no further apart than the radius and than what some pair of boxes of the same two components shows."""
    near = staged(pairs.withColumn("apart", _apart()).where(F.col("apart") <= radius).withColumn("shown", _shown()), "near")
    bound = near.groupBy("comp", "comp2").agg(F.min("shown").alias("bound"))
    return near.join(bound, ["comp", "comp2"]).where("apart <= bound").drop("shown", "apart", "bound")


def _links(live: DataFrame, side: float, level: int, radius: float) -> DataFrame:
    """(ca, cb, a, b, w): for components with events within the radius of each other, their lightest edge. live: events with
    core and comp."""
    fine, at, home = ("cx", "cy", "ct"), ("kx", "ky", "kt"), ("hx", "hy", "ht")
    placed = staged(_cells(_cells(live, side, fine), side * max(1, 2 ** (level - 2)), at), "placed")
    wide = _boxes(placed, *at, "comp")
    around = wide.withColumns(dict(zip(home, map(F.col, at), strict=True)))
    for c in at:
        around = around.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    # Where all boxes around are of one component there is nothing to pair.
    mixed = around.groupBy(*at).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select(*at)
    pairs = _promising(around.join(mixed, list(at), "left_semi").join(_second(wide, *at), list(at)).where("comp < comp2"), radius)
    pairs = pairs.select("comp", "comp2", *(F.col(h).alias(c) for h, c in zip(home, at, strict=True)), *(F.col(c).alias(f"{c}2") for c in at))
    # The same with the small cells of each pair.
    small = _boxes(placed, *at, *fine, "comp")
    both = pairs.join(small, ["comp", *at]).join(_second(small), ["comp2", *(f"{c}2" for c in at)])
    asked = _promising(both, radius).select("comp", "comp2", *fine, *(f"{c}2" for c in fine)).distinct()
    asked = staged(asked.withColumn("pair", F.monotonically_increasing_id()), "asked")
    # A group holds some PAIRS pairs, since each group is a call.
    groups = asked.count() // PAIRS + 1
    deal = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).alias("deal")
    left = asked.join(placed.select("comp", *fine, *_POINT, "core"), ["comp", *fine]).select("pair", F.col("comp").alias("ca"), F.col("comp2").alias("cb"), *_POINT, "core")
    right = asked.select("pair", F.col("comp2").alias("comp"), *(F.col(f"{c}2").alias(c) for c in fine)).join(placed.select("comp", *fine, *_POINT, "core"), ["comp", *fine]).select(*(F.col(c).alias(f"{c}2") for c in ("pair", *_POINT, "core")))
    edges = left.groupBy(deal("pair")).cogroup(right.groupBy(deal("pair2"))).applyInArrow(_all_lightest, "ca long, cb long, w double, a long, b long")
    best = edges.where(F.col("w") <= radius).groupBy("ca", "cb").agg(F.min(F.struct("w", "a", "b")).alias("e"))
    return best.select("ca", "cb", "e.a", "e.b", "e.w")


def candidate_edges(points: DataFrame, side: float, limit: float, small: int = SMALL) -> DataFrame:
    """(a, b, w): rows a < b. Holds the least spanning tree of all events (row, x, y, t, core)."""
    radius = side / 4
    edges = staged(_spread(points.where(F.col("core") <= radius), side, radius).groupBy("cx", "cy", "ct").applyInArrow(_forest(radius), "a long, b long, w double, link boolean"), "forest")
    roots = contracted_components(edges.where("link"), staged, "a", "b", discard, small)
    edges = edges.where("w is not null").select("a", "b", "w")
    comps = staged(points.join(roots.withColumnRenamed("node", "row"), "row", "left").select("row", "x", "y", "t", "core", F.coalesce("root", "row").alias("comp")), "comps")
    level = 0
    while radius <= limit and (ends := comps.agg(F.min("comp"), F.max("comp")).first())[0] != ends[1]:
        level, radius = level + 1, 2 * radius
        links = staged(_links(comps.where(F.col("core") <= radius), side, level, radius), "links")
        if links.isEmpty():
            continue
        edges = edges.unionByName(links.select("a", "b", "w"))
        to = contracted_components(links, staged, "ca", "cb", discard, small).select(F.col("node").alias("comp"), "root")
        comps = staged(comps.join(to, "comp", "left").select("row", "x", "y", "t", "core", F.coalesce("root", "comp").alias("comp")), "comps")
    return edges


# --- 3. single linkage -----------------------------------------------------------------------------------------------

_NODE_BITS = 42


def _place(row: str) -> Column:
    """The inner piece that a place of repeated events is, by its first row; those made by halving are numbered below."""
    return F.col(row) + (1 << _NODE_BITS)


def _places(stars: DataFrame, least: int) -> DataFrame:
    """What _fold would give for the star of each place: all its edges weigh 0, so from `least` events on it is one cluster that
    all leave at once, and else its events are members of what it meets."""
    piece, full = _place("first"), F.col("size") >= least
    seg = piece * _SEGMENTS + 1
    each = stars.select(F.when(full, "fall").otherwise("member").alias("kind"), F.when(full, seg).otherwise(piece).alias("seg"), F.col("row").alias("node"), F.lit(-1).cast("long").alias("inner"), F.lit(0.0).alias("w"), F.lit(1).cast("long").alias("size"))
    tops = stars.where(full & (F.col("row") == F.col("first"))).select(F.lit("top").alias("kind"), piece.alias("seg"), seg.alias("node"), F.lit(-1).cast("long").alias("inner"), F.lit(0.0).alias("w"), F.col("size").cast("long").alias("size"))
    return each.unionByName(tops)


def pieces(edges: DataFrame, bound: int = PIECE, small: int = SMALL, stars: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges with a piece and its nodes u, v; nodes (piece, node, inner, size) that stand for an inner piece of so many
    events). Piece 0 is the outermost one. The first rows of the places `stars` are nodes from the start."""
    now = staged(edges.select("a", "b", "w", F.lit(0).cast("long").alias("piece"), F.col("a").alias("u"), F.col("b").alias("v")), "pieces")
    nodes = now.sparkSession.createDataFrame([], "piece long, node long, inner long, size long")
    if stars is not None:
        nodes = stars.where("first = row").select(F.lit(0).cast("long").alias("piece"), F.col("first").alias("node"), _place("first").alias("inner"), F.col("size").cast("long").alias("size"))
    key = lambda c: F.shiftleft(F.col("piece"), _NODE_BITS).bitwiseOR(F.col(c))  # noqa: E731  a node of a piece
    mask, top = F.lit((1 << _NODE_BITS) - 1), 1
    while True:
        large = now.groupBy("piece").agg(F.count("*").alias("n")).where(F.col("n") > bound).select("piece")
        if large.isEmpty():
            return now, nodes
        # The median by weight; where most edges weigh the same, by weight and then by row.
        own = now.join(large, "piece", "left_semi")
        mid = own.groupBy("piece").agg(F.percentile_approx("w", 0.5, F.lit(10_000)).alias("mid"))
        mid = own.join(mid, "piece").groupBy("piece", "mid").agg(
            F.max("w").alias("most"), F.min("w").alias("least"), F.percentile_approx(F.when(F.col("w") == F.col("mid"), F.col("a")), 0.5, F.lit(10_000)).alias("row"), F.max(F.when(F.col("w") == F.col("mid"), F.col("a"))).alias("last")
        )
        until = F.when(F.col("mid") < F.col("most"), F.lit(2**62)).when(F.col("least") < F.col("mid"), F.lit(-1)).when(F.col("row") < F.col("last"), F.col("row")).otherwise(F.col("row") - 1)
        cut = mid.select("piece", "mid", until.alias("until"))
        # One row for each large piece: fewer than edges / bound.
        marked = now.join(cut, "piece", "left").withColumn("light", F.coalesce((F.col("w") < F.col("mid")) | (F.col("w") == F.col("mid")) & (F.col("a") <= F.col("until")), F.lit(False)))
        marked = staged(marked.drop("mid", "until"), "marked")
        roots = contracted_components(marked.where("light").select(key("u").alias("a"), key("v").alias("b")), staged, "a", "b", discard, small)
        fresh = with_position(roots.select("root").distinct(), "root", name="nth").select("root", (F.col("nth") + top).alias("inner"))
        named = staged(roots.join(fresh, "root"), "named")
        held = nodes.select(key("node").alias("node"), "size")
        sizes = named.join(held, "node", "left").groupBy("root", "inner").agg(F.sum(F.coalesce("size", F.lit(1))).alias("size"))
        shells = sizes.select(F.shiftright("root", _NODE_BITS).alias("piece"), F.col("root").bitwiseAND(mask).alias("node"), "inner", "size")
        into = named.select(F.col("node").alias("k"), "inner", F.col("root").bitwiseAND(mask).alias("to"))
        inside = marked.where("light").join(into, key("u") == F.col("k")).select("a", "b", "w", F.col("inner").alias("piece"), "u", "v")
        heavy = marked.where("not light")
        for c in ("u", "v"):
            heavy = heavy.withColumn("__k", key(c)).join(into.select(F.col("k").alias("__k"), F.col("to").alias(f"__{c}")), "__k", "left").drop("__k")
        outside = heavy.select("a", "b", "w", "piece", F.coalesce("__u", "u").alias("u"), F.coalesce("__v", "v").alias("v")).where("u <> v")
        moved = nodes.withColumn("k", key("node")).join(into.select("k", F.col("inner").alias("into")), "k", "left").select(F.coalesce("into", "piece").alias("piece"), "node", "inner", "size")
        now, nodes = staged(inside.unionByName(outside), "pieces"), staged(moved.unionByName(shells), "nodes")
        top = (nodes.where(F.col("inner") < (1 << _NODE_BITS)).agg(F.max("inner")).first()[0] or 0) + 1


_FOLDED = "kind string, seg long, node long, inner long, w double, size long"
_SEGMENTS = 1 << 20


def _fold(least: int):
    """Kruskal's merges of one piece. Rows by kind: fall (node, its inner piece if it is one, and how many events leave the
    cluster seg at w), split (the cluster seg parts into clusters, of which node is one of size events), member (node of a
    piece `seg` that stays smaller than a cluster), top (the cluster `node` that piece `seg` ends as), light (its lightest edge
    above zero). Clusters are numbered by piece; -1 - p is the one that the inner piece p ends as."""

    def run(key: tuple, edges: pa.Table, nodes: pa.Table) -> pa.Table:
        piece = key[0].as_py()
        a, b, w, u, v = _array(edges, "a", "b", "w", "u", "v")
        by = np.lexsort((b, a, w))
        known, inner, weight = _array(nodes, "node", "inner", "size")
        ids = np.unique(np.concatenate((u, v, known)))
        size, stands = np.ones(len(ids), np.int64), np.full(len(ids), -1)
        size[np.searchsorted(ids, known)], stands[np.searchsorted(ids, known)] = weight, inner
        size, stands, own = size.tolist(), stands.tolist(), list(size)
        seg = [-1 - stands[i] if size[i] >= least else None for i in range(len(ids))]
        held = [[i] for i in range(len(ids))]
        parent = list(range(len(ids)))
        rows: list[tuple] = []
        made, light = 0, math.inf

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def fall(c, members, weight):
            rows.extend(("fall", c, int(ids[i]), stands[i], weight, own[i]) for i in members)

        for i, j, weight in zip(np.searchsorted(ids, u[by]).tolist(), np.searchsorted(ids, v[by]).tolist(), w[by].tolist(), strict=True):
            i, j = find(i), find(j)
            if i == j:
                continue
            if weight > 0:
                light = min(light, weight)
            if size[i] < size[j]:
                i, j = j, i
            if seg[j] is not None:
                made += 1
                new = piece * _SEGMENTS + made
                rows += [("split", new, seg[k], -1, weight, size[k]) for k in (i, j)]
                seg[i] = new
            elif seg[i] is not None:
                fall(seg[i], held[j], weight)
            elif size[i] + size[j] >= least:
                made += 1
                seg[i] = piece * _SEGMENTS + made
                fall(seg[i], held[i] + held[j], weight)
            else:
                held[i] += held[j]
            parent[j] = i
            size[i] += size[j]
            held[j] = []
        root = find(0)
        if seg[root] is None:
            rows += [("member", piece, int(ids[i]), stands[i], 0.0, own[i]) for i in held[root]]
        else:
            rows.append(("top", piece, seg[root], -1, 0.0, size[root]))
        if light < math.inf:
            rows.append(("light", piece, -1, -1, light, 0))
        names, types = ("kind", "seg", "node", "inner", "w", "size"), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*rows, strict=True), types, strict=True)})

    return run


def condensed(edges: DataFrame, least: int, bound: int = PIECE, small: int = SMALL, stars: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(clusters (id, parent, size, stability, birth), falls (row, id)) of the condensed tree; the root's parent is null. stars: all
    rows (first, row, size) of the places whose events but the first have no edges here."""
    now, nodes = pieces(edges, bound, small, stars)
    folded = (now.groupBy("piece").cogroup(nodes.select(F.col("piece").alias("in"), "node", "inner", "size").groupBy("in")).applyInArrow(_fold(least), _FOLDED))
    folded = staged(folded if stars is None else folded.unionByName(_places(stars, least)), "folded")
    alias = folded.where("kind = 'top'").select((-1 - F.col("seg")).alias("name"), F.col("node").alias("id"))
    alias = staged(alias, "alias")
    while not (far := alias.where("id < 0")).isEmpty():  # an inner piece that passes through: point at what it ends as
        alias = staged(alias.where("id >= 0").unionByName(far.join(alias.select(F.col("name").alias("id"), F.col("id").alias("to")), "id").select("name", F.col("to").alias("id"))), "alias")

    def resolved(df: DataFrame, c: str) -> DataFrame:
        return df.join(alias.select(F.col("name").alias(c), F.col("id").alias("__to")), c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")

    lightest = folded.where("kind = 'light'").agg(F.min("w")).first()[0]
    finite = 1 / lightest if lightest else 1.0
    rate = F.when(F.col("w") > 0, 1 / F.col("w")).otherwise(F.lit(finite))
    falls = staged(resolved(folded.where("kind = 'fall'"), "seg").withColumn("rate", rate), "falls")
    splits = staged(resolved(resolved(folded.where("kind = 'split'"), "seg"), "node").withColumn("rate", rate), "splits")
    lost = falls.unionByName(splits).groupBy(F.col("seg").alias("id")).agg(F.sum(F.col("rate") * F.col("size")).alias("mass"), F.sum("size").alias("size"))
    births = splits.select(F.col("node").alias("id"), F.col("seg").alias("parent"), F.col("rate").alias("birth"))
    clusters = lost.join(births, "id", "left").select("id", "parent", "size", (F.col("mass") - F.coalesce("birth", F.lit(0.0)) * F.col("size")).alias("stability"), F.coalesce("birth", F.lit(0.0)).alias("birth"))
    members = folded.where("kind = 'member'").select(F.col("seg").alias("inner"), F.col("node").alias("row"), F.col("inner").alias("deeper"))
    open_ = falls.select(F.col("seg").alias("id"), F.col("node").alias("row"), "inner")
    out = open_.where("inner < 0").select("row", "id")
    while not (deep := open_.where("inner >= 0")).isEmpty():
        open_ = staged(deep.select("id", "inner").join(members, "inner").select("id", "row", F.col("deeper").alias("inner")), "members")
        out = out.unionByName(open_.where("inner < 0").select("row", "id"))
    return staged(clusters, "clusters"), out


# --- 4. the choice of clusters ---------------------------------------------------------------------------------------


def _choose(method: str, epsilon: float):
    """(id, best, owner) of all clusters of a table that fits one group: whether it is best by itself, and the chosen one it
    belongs to."""

    def run(table: pa.Table) -> pa.Table:
        ids, parents = (table.column(n).to_pylist() for n in ("id", "parent"))
        at = {c: k for k, c in enumerate(ids)}
        up = [at.get(p) for p in parents]
        stability, below, birth = (table.column(n).to_pylist() for n in ("stability", "below", "birth"))
        leaf = table.column("leaf").to_pylist()
        kids: list[list[int]] = [[] for _ in ids]
        for k, p in enumerate(up):
            if p is not None:
                kids[p].append(k)
        order, stack = [], [k for k, p in enumerate(up) if p is None]
        while stack:
            order.append(k := stack.pop())
            stack += kids[k]
        best = [False] * len(ids)
        worth = list(below)
        for k in reversed(order):
            worth[k] += sum(worth[i] for i in kids[k])
            end = leaf[k] and not kids[k]
            best[k] = parents[k] is not None and (end if method == "leaf" else end or stability[k] >= worth[k])
            if best[k]:
                worth[k] = stability[k]
        chosen = lifted(order, up, birth, parents, best, epsilon)
        owner: list[int | None] = [None] * len(ids)
        for k in order:
            above = owner[up[k]] if up[k] is not None else None
            owner[k] = above if above is not None else ids[k] if chosen[k] else None
        return pa.table({"id": pa.array(ids, pa.int64()), "best": best, "worth": pa.array(worth, pa.float64()), "owner": pa.array(owner, pa.int64())})

    return run


def lifted(order: list[int], up: list, birth: list[float], parents: list, best: list[bool], epsilon: float) -> list[bool]:
    """Which clusters are chosen: the topmost best ones, each moved up to the first born at a distance of epsilon or more (but
    not to the root)."""
    out, covered = [False] * len(best), [False] * len(best)
    for k in order:
        covered[k] = up[k] is not None and (best[up[k]] or covered[up[k]])
        if best[k] and not covered[k]:
            c = k
            while epsilon > 0 and birth[c] > 0 and 1 / birth[c] < epsilon and up[c] is not None and parents[up[c]] is not None:
                c = up[c]
            out[c] = True
    return out


def owners(clusters: DataFrame, method: str = "eom", epsilon: float = 0.0, bound: int = PIECE) -> DataFrame:
    """(id, owner): the chosen cluster that each cluster belongs to, if any."""
    if method not in ("eom", "leaf"):
        raise ValueError("method must be eom or leaf")
    shape, none = "id long, best boolean, worth double, owner long", F.lit(None).cast("long")
    open_ = clusters.select("id", "parent", "stability", "birth", F.lit(0.0).alias("below"), F.lit(True).alias("leaf"))
    if clusters.count() <= bound:
        return open_.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_choose(method, epsilon), shape).select("id", "owner")
    best = []
    while not open_.isEmpty():
        open_ = staged(open_, "open")
        if open_.count() <= bound:
            best.append(open_.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_choose(method, 0.0), shape).select("id", "best"))
            break
        inner = open_.select(F.col("parent").alias("id")).distinct()
        ends = open_.join(inner, "id", "left_anti")
        good = F.col("parent").isNotNull() & (F.col("leaf") if method == "leaf" else F.col("leaf") | (F.col("stability") >= F.col("below")))
        ends = staged(ends.withColumn("best", good).withColumn("worth", F.when(good, F.col("stability")).otherwise(F.col("below"))), "ends")
        best.append(ends.select("id", "best"))
        more = ends.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.sum("worth").alias("more"))
        open_ = open_.join(inner, "id", "left_semi").join(more, "id", "left").select("id", "parent", "stability", "birth", (F.col("below") + F.coalesce("more", F.lit(0.0))).alias("below"), (F.col("leaf") & F.col("more").isNull()).alias("leaf"))
    flags = best[0]
    for f in best[1:]:
        flags = flags.unionByName(f)
    picks = staged(_topmost(clusters.join(flags, "id").select("id", "parent", F.when(F.col("best"), F.col("id")).alias("pick"))), "picks")
    if epsilon <= 0:
        return picks.withColumnRenamed("pick", "owner")
    # Up by one until all are high enough; then the topmost again.
    moving = picks.where("id = pick").select("id").join(clusters, "id").select("id", "parent", "birth")
    over, root = [], clusters.where("parent is null").select(F.col("id").alias("parent"))
    while not moving.isEmpty():
        moving = staged(moving, "moving")
        rises = (F.col("birth") > 0) & (1 / F.col("birth") < epsilon)
        stay = moving.where(~rises).unionByName(moving.where(rises).join(root, "parent", "left_semi").select("id", "parent", "birth"))
        over.append(stay.select("id"))
        moving = moving.where(rises).join(root, "parent", "left_anti").select(F.col("parent").alias("id")).distinct().join(clusters, "id").select("id", "parent", "birth")
    held = over[0] if over else picks.where("false").select("id")
    for o in over[1:]:
        held = held.unionByName(o)
    marks = clusters.join(held.distinct().withColumn("pick", F.col("id")), "id", "left").select("id", "parent", "pick")
    return _topmost(marks).withColumnRenamed("pick", "owner")


def _topmost(marks: DataFrame) -> DataFrame:
    """(id, pick): the topmost pick on the way from each cluster to the root, by pointer jumping."""
    now = staged(marks, "picks")
    while not now.where("parent is not null").isEmpty():
        above = now.select(F.col("id").alias("parent"), F.col("parent").alias("up"), F.col("pick").alias("higher"))
        now = staged(now.join(above, "parent", "left").select("id", F.col("up").alias("parent"), F.coalesce("higher", "pick").alias("pick")), "picks")
    return now.select("id", "pick")


# --- all of it -------------------------------------------------------------------------------------------------------


def _repeats(points: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None]:
    """(points without those beyond the first k + 1 of a place, all rows (first, row, size) of the places that have more)."""
    many = points.groupBy("x", "y", "t").agg(F.count("*").alias("size"), F.min("row").alias("first")).where(F.col("size") > k + 1)
    many = staged(many, "repeats")
    if many.isEmpty():
        return points, None
    stars = points.join(many, ["x", "y", "t"]).select("first", "row", "size")
    nth = F.row_number().over(Window.partitionBy("x", "y", "t").orderBy("row"))
    return staged(points.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth"), "points"), staged(stars, "stars")


def cluster_whole(df: DataFrame, threshold: float, min_cluster_size: int, min_samples: int | None = None, epsilon: float = 0.0, method: str = "eom", label: str = "cluster", cell: int = CELL, piece: int = PIECE, small: int = SMALL) -> DataFrame:
    """df with `label`: clusters from 0 in order of their least row, -1 noise. Features are x, y, t / threshold in float32."""
    if min_cluster_size < 2:
        raise ValueError("min_cluster_size must be 2 or more")
    placed = staged(with_position(df, name="__row"), "rows")
    feature = lambda c: F.col(c).cast("float").cast("double")
    points = staged(placed.select(F.col("__row").alias("row"), feature("x").alias("x"), feature("y").alias("y"), (F.col("t") / threshold).cast("float").cast("double").alias("t")), "points")
    n, *ends = points.agg(F.count("*"), *(f(c) for c in "xyt" for f in (F.min, F.max))).first()
    if n < 2 or n < min_cluster_size:
        return placed.drop("__row").withColumn(label, F.lit(NOISE))
    k = min(min_samples or min_cluster_size, n - 1)
    span = [max(hi - lo, 1e-3) for lo, hi in zip(ends[::2], ends[1::2], strict=True)]
    limit = math.hypot(*span)
    points, stars = _repeats(points, k)
    side = min(max(span), (span[0] * span[1] * span[2] * cell / n) ** (1 / 3))
    while side > limit * 1e-9 and _cells(points, side).groupBy("cx", "cy", "ct").count().agg(F.max("count")).first()[0] > max(4 * cell, 4 * (k + 1)):
        side /= 2
    if stars is None:
        known = staged(points.join(core_distances(points, k, side, limit), "row"), "known")
    else:
        firsts = stars.where("first = row").select("row")
        at_rest = points.join(firsts, "row", "left_semi").withColumn("core", F.lit(0.0))
        asked = points.join(firsts.join(points, "row").select("x", "y", "t"), ["x", "y", "t"], "left_anti")
        known = staged(at_rest.unionByName(asked.join(core_distances(points, k, side, limit, asked.select("row")), "row").select(at_rest.columns)), "known")
    edges = candidate_edges(known, side, limit, small)
    clusters, falls = condensed(edges, min_cluster_size, piece, small, stars)
    owned = staged(falls.join(owners(clusters, method, epsilon, piece), "id").where("owner is not null").select("row", "owner"), "owned")
    # Numbered by first row, without a single-partition sort.
    first = with_position(owned.groupBy("owner").agg(F.min("row").alias("first")), "first", name="nth")
    labels = owned.join(first, "owner").select(F.col("row").alias("__row"), F.col("nth").cast("int").alias(label))
    return placed.join(labels, "__row", "left").na.fill(NOISE, [label]).drop("__row")
