"""Hierarchical density clustering: of a whole recording (hierarchy.cluster_whole), or of count windows.

The hierarchy of a window is exact (mutual-reachability spanning tree, condensed tree, excess of mass or leaves);
windows are clustered in parallel and stitched as in density.chunked, so memory is bounded by the window."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .density import chunked

def core_distances(x: np.ndarray, k: int) -> np.ndarray:
    """The distance of each row to its k-th nearest other one, found once for rows of one place."""
    if not len(x):
        return np.empty(0)
    _, first, place = np.unique(x, axis=0, return_index=True, return_inverse=True)
    core = np.empty(len(first))
    for p, i in enumerate(first.tolist()):
        core[p] = np.partition(_squares(x, i), k)[k]
    return np.sqrt(core)[place.ravel()]


def _squares(x: np.ndarray, i: int) -> np.ndarray:
    dx, dy, dt = x[:, 0] - x[i, 0], x[:, 1] - x[i, 1], x[:, 2] - x[i, 2]
    return dx * dx + dy * dy + dt * dt


def spanning_tree(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, weight) of the mutual-reachability spanning tree in ascending (weight, least row a, greatest row b), by Prim in
    O(n^2) time and O(n) memory. Edges of the same weight are told apart by their rows, so there is one tree.

    Rows of one place whose core distance is 0 follow the first of them at weight 0, and any edge to them is least at the first;
    so only it takes part."""
    rest = np.flatnonzero(core == 0)
    if len(rest):
        _, first, place = np.unique(x[rest], axis=0, return_index=True, return_inverse=True)
        head = rest[first][place.ravel()]
        if len(other := rest[head != rest]):
            kept = np.setdiff1d(np.arange(len(x)), other)
            a, b, w = spanning_tree(x[kept], core[kept])
            a, b, w = np.concatenate((head[head != rest], kept[a])), np.concatenate((other, kept[b])), np.concatenate((np.zeros(len(other)), w))
            by = np.lexsort((b, a, w))
            return a[by], b[by], w[by]
    n = len(x)
    inside = np.zeros(n, bool)
    best, via = np.full(n, np.inf), np.full(n, n)
    a, b, w = np.empty(n - 1, int), np.empty(n - 1, int), np.empty(n - 1)
    at = 0
    for k in range(n - 1):
        inside[at] = True
        best[at] = np.inf
        d = np.maximum(np.maximum(np.sqrt(_squares(x, at)), core), core[at])
        closer = d < best
        # An equally light edge precedes if its rows do, which is when it comes from a lower row.
        closer |= (d == best) & (at < via)
        closer &= ~inside
        best[closer], via[closer] = d[closer], at
        least = best.min()
        tied = np.flatnonzero((best == least) & ~inside)
        nxt = int(tied[0])
        if len(tied) > 1:
            lo, hi = np.minimum(tied, via[tied]), np.maximum(tied, via[tied])
            nxt = int(tied[np.lexsort((hi, lo))[0]])
        a[k], b[k], w[k] = min(nxt, via[nxt]), max(nxt, via[nxt]), least
        at = nxt
    by = np.lexsort((b, a, w))
    return a[by], b[by], w[by]


def along(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(order, how many rows behind each are within the radius) by the axis on which these are fewest."""
    orders = [np.argsort(x[:, i], kind="stable") for i in range(3)]
    behind = [np.searchsorted(v, v + radius * (1 + 1e-9), "right") - np.arange(len(v)) - 1 for v in (x[by, i] for i, by in enumerate(orders))]
    best = int(np.argmin([n.sum() for n in behind]))
    return orders[best], behind[best]


def short_forest(x: np.ndarray, core: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges up to the radius of spanning_tree, in its order. Only pairs that lie so near are looked at, found along the axis
    that tells most apart; where they are many after all, Prim takes less."""
    n, short = len(x), lambda a, b, w: (a[w <= radius], b[w <= radius], w[w <= radius])
    by, reach = along(x, radius)
    x0, x1, x2 = (np.ascontiguousarray(x[by, i]) for i in range(3))
    c, found, most = core[by], [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))], min(n * n // 10, 1 << 22)
    for k in range(1, int(reach.max(initial=0)) + 1):
        dx, dy, dt = x0[k:] - x0[:-k], x1[k:] - x1[:-k], x2[k:] - x2[:-k]
        d = np.maximum(np.maximum(np.sqrt(dx * dx + dy * dy + dt * dt), c[k:]), c[:-k])
        if len(near := np.flatnonzero(d <= radius)):
            i, j = by[near], by[near + k]
            found.append((np.minimum(i, j), np.maximum(i, j), d[near]))
            most -= len(near)
            if most < 0:
                return short(*spanning_tree(x, core))
    a, b, w = (np.concatenate(f) for f in zip(*found, strict=True))
    order = np.lexsort((b, a, w))
    a, b, w = a[order], b[order], w[order]
    # Boruvka: each component takes its first edge.
    e, u, v, kept = np.arange(len(a)), a, b, [np.zeros(0, int)]
    while len(e):
        first, root = np.full(n, len(a)), np.arange(n)
        first[u[::-1]] = e[::-1]
        other = np.full(n, len(a))
        other[v[::-1]] = e[::-1]
        first = np.minimum(first, other)
        joins = np.flatnonzero(first < len(a))
        at = np.searchsorted(e, first[joins])
        kept.append(first[joins])
        root[joins] = u[at] + v[at] - joins
        pairs = joins[(root[root[joins]] == joins) & (joins < root[joins])]
        root[pairs] = pairs
        while not np.array_equal(up := root[root], root):
            root = up
        u, v = root[u], root[v]
        apart = u != v
        e, u, v = e[apart], u[apart], v[apart]
    tree = np.unique(np.concatenate(kept))
    return a[tree], b[tree], w[tree]


def local_hdbscan(x: np.ndarray, min_cluster_size: int, min_samples: int | None = None, epsilon: float = 0.0, method: str = "eom") -> np.ndarray:
    """Labels from 0 in order of the least row, -1 noise."""
    n = len(x)
    if n < 2 or n < min_cluster_size:
        return np.full(n, -1)
    x = x.astype(float)
    a, b, w = spanning_tree(x, core_distances(x, min(min_samples or min_cluster_size, n - 1)))
    # Single linkage: node n + k joins two nodes at weight w[k].
    parent = list(range(2 * n - 1))
    top = list(range(2 * n - 1))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, right, size = [0] * (n - 1), [0] * (n - 1), [1] * n + [0] * (n - 1)
    for k in range(n - 1):
        i, j = top[find(int(a[k]))], top[find(int(b[k]))]
        left[k], right[k], size[n + k] = i, j, size[i] + size[j]
        parent[find(int(a[k]))] = n + k
        parent[find(int(b[k]))] = n + k
        top[n + k] = n + k
    lam = [1 / v if v > 0 else math.inf for v in w]

    def leaves(node):
        out, stack = [], [node]
        while stack:
            i = stack.pop()
            if i < n:
                out.append(i)
            else:
                stack += (left[i - n], right[i - n])
        return out

    # Condensed tree: clusters with birth, children, and the points that leave them with their lambda.
    birth, kids, lost, up = {0: 0.0}, {0: []}, {0: []}, {0: None}
    stack = [(2 * n - 2, 0)]
    while stack:
        node, c = stack.pop()
        while node >= n:
            k = node - n
            big = [i for i in (left[k], right[k]) if size[i] >= min_cluster_size]
            small = [i for i in (left[k], right[k]) if size[i] < min_cluster_size]
            for i in small:
                lost[c] += [(p, lam[k]) for p in leaves(i)]
            if len(big) == 2:
                for i in big:
                    new = len(birth)
                    birth[new], kids[new], lost[new], up[new] = lam[k], [], [], c
                    kids[c].append((new, lam[k], size[i]))
                    stack.append((i, new))
                break
            if not big:
                break
            node = big[0]
        else:
            lost[c].append((node, lam[-1] if lam else 0.0))
    finite = max([v for v in lam if math.isfinite(v)], default=1.0)
    cut = lambda v: v if math.isfinite(v) else finite
    stability = {c: sum(cut(v) - cut(birth[c]) for _, v in lost[c]) + sum((cut(v) - cut(birth[c])) * s for _, v, s in kids[c]) for c in birth}
    if method == "leaf":
        chosen = {c for c in birth if not kids[c] and c}
    elif method == "eom":
        chosen, worth = set(), {}
        for c in sorted(birth, reverse=True):
            below = sum(worth[k] for k, _, _ in kids[c])
            if c and (not kids[c] or stability[c] >= below):
                worth[c] = stability[c]
                chosen.add(c)
            else:
                worth[c] = below
        for c in sorted(chosen):
            u = up[c]
            while u is not None:
                if u in chosen:
                    chosen.discard(c)
                    break
                u = up[u]
    else:
        raise ValueError("method must be eom or leaf")
    if epsilon > 0:
        lifted = set()
        for c in chosen:
            while up[c] and birth[c] > 0 and 1 / birth[c] < epsilon:
                c = up[c]
            lifted.add(c)
        chosen = {c for c in lifted if not any(_above(c, d, up) for d in lifted)}
    label = np.full(n, -1)
    for c in chosen:
        todo = [c]
        while todo:
            k = todo.pop()
            label[[p for p, _ in lost[k]]] = c
            todo += [i for i, _, _ in kids[k]]
    seen = {c: i for i, c in enumerate(dict.fromkeys(label[label >= 0].tolist()))}
    return np.array([seen.get(c, -1) for c in label.tolist()])


def _above(c: int, d: int, up: dict) -> bool:
    u = up[c]
    while u is not None:
        if u == d:
            return True
        u = up[u]
    return False


def hdbscan(df: DataFrame, threshold: float = 1e4, min_cluster_size: int = 10, min_samples: int | None = None, epsilon: float = 0.0, method: str = "eom", chunk: int | None = None, overlap: int | None = None, label: str = "cluster", **guards) -> DataFrame:
    """df with `label`; features are x, y, t / threshold in float32. One hierarchy over all rows; with `chunk`, count windows
    are clustered apart and stitched."""
    if chunk is None:
        from .hierarchy import cluster_whole

        return cluster_whole(df, threshold, min_cluster_size, min_samples, epsilon, method, label)

    def fit(pdf: pd.DataFrame) -> np.ndarray:
        x = np.column_stack((pdf["x"], pdf["y"], pdf["t"] / threshold)).astype(np.float32)
        return local_hdbscan(x, min_cluster_size, min_samples, epsilon, method)

    return chunked(df, fit, chunk, chunk // 5 if overlap is None else overlap, label, **guards)
