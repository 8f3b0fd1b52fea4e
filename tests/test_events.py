"""Event operators against small sequential models written from their definitions, and on odd tables."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import expr
from pulsegrid.model import with_position
from pulsegrid.operators import cluster, columns, components, density, direction, dstream, edges, evaluate, filters, frames, hdbscan, hierarchy, meanshift, velocity, windows
from pulsegrid.plans.staging import staged

EV = "seq long, t long, x int, y int, p int, pol int"


def events(spark, rows):
    return spark.createDataFrame(rows, EV)


def rand_events(seed, n, w=8, h=6, span=400):
    rng = random.Random(seed)
    return [(k, t, rng.randrange(w), rng.randrange(h), rng.randrange(2), rng.randrange(4)) for k, t in enumerate(sorted(rng.randrange(span) for _ in range(n)))]


def sweep(rows, k, carry):
    states = [[0] * k for _ in range(4)]
    out = []
    tiles = sorted({(y // k, x // k) for _, _, x, y, *_ in rows})
    for py, px in tiles:
        if carry == "none":
            states = [[0] * k for _ in range(4)]
        for seq, t, x, y, *_ in rows:
            if (y // k, x // k) != (py, px):
                continue
            lx, ly = x % k, y % k
            for d, (lane, v) in enumerate(((lx, ly), (ly, lx), (lx, k - 1 - ly), (ly, k - 1 - lx))):
                s = states[d][lane]
                s = s + 1 if v == s else 0 if v > s else s
                if s == k:
                    s = 0
                    out.append((seq, t, px, py, d))
                states[d][lane] = s
    return sorted(out)


@pytest.mark.parametrize("carry", ["none", "raster"])
@pytest.mark.parametrize("k", [2, 3])
def test_patch_direction(spark, carry, k):
    rows = rand_events(k, 500, span=200)  # with ties
    got = sorted(tuple(r) for r in direction.patch_direction(events(spark, rows), k, carry).select("seq", "t", "x", "y", "pol").collect())
    assert got == sweep(rows, k, carry) and got


def test_folds_keep_a_lane_in_one_task(spark):
    """A join on the keys before a fold, whose shuffle AQE splits: the lanes of the fold stay whole."""
    rows = rand_events(21, 3000, 8, 6, 900)
    small = {"autoBroadcastJoinThreshold": "-1", "adaptive.skewJoin.skewedPartitionFactor": "0", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "adaptive.advisoryPartitionSizeInBytes": "2k"}
    try:
        for c, v in small.items():
            spark.conf.set(f"spark.sql.{c}", v)
        got = sorted(tuple(r) for r in direction.patch_direction(events(spark, rows).repartition(8), 2, "raster").select("seq", "t", "x", "y", "pol").collect())
    finally:
        for c in small:
            spark.conf.unset(f"spark.sql.{c}")
    assert got == sweep(rows, 2, "raster") and got



def chain(rows, k, n=16):
    s = np.zeros((n + 2, n + 2, 4), int)
    ahead = {0: (1, 0), 1: (0, 1), 2: (-1, 0), 3: (0, -1)}
    out = []
    for seq, t, x, y, _, d in rows:
        i, j = y + 1, x + 1
        a, b = ahead[d]
        rev = (d + 2) % 4
        s[i, j, d] = s[i - a, j - b, d] + 1
        r = s[i + a, j + b, rev]
        for m in range(r + 1):
            s[i + a * m, j + b * m, rev] = 0
        if s[i, j, d] == k:
            out.append((seq, t, x, y, d))
            for m in range(k):
                s[i - a * m, j - b * m, d] = 0
    return sorted(out)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_multipatch_direction(spark, k):
    rows = rand_events(k + 10, 700, 5, 4)
    got = sorted(tuple(r) for r in direction.multipatch_direction(events(spark, rows), k).select("seq", "t", "x", "y", "pol").collect())
    assert got == chain(rows, k) and got


def test_roi(spark):
    rows, roi = rand_events(3, 400, 12, 12, 150), rand_events(4, 120, 3, 3, 150)
    mask, at, want = {}, 0, []
    for seq, t, x, y, *_ in rows:
        while at < len(roi) and roi[at][1] < t:
            _, _, rx, ry, _, d = roi[at]
            put, clear = {0: ((0, 1), (0, -1)), 1: ((1, 0), (-1, 0)), 2: ((0, -1), (0, 0)), 3: ((-1, 0), (0, 0))}[d]
            mask[rx + put[0], ry + put[1]] = 1
            mask[rx + clear[0], ry + clear[1]] = 0
            at += 1
        if roi[0][1] < t <= roi[-1][1] and mask.get((x // 4, y // 4)):
            want.append(seq)
    got = direction.apply_roi(events(spark, rows), events(spark, roi), 4)
    assert got.columns == EV.replace(" long", "").replace(" int", "").split(", ")
    assert sorted(r["seq"] for r in got.collect()) == want and want
    fold = {r["seq"] for r in direction.roi_mask_fold(events(spark, rows), events(spark, roi), 4).collect()}
    assert {r[0] for r in rows if r[0] in fold and roi[0][1] < r[1] <= roi[-1][1]} == set(want)
    assert direction.apply_roi(events(spark, rows), events(spark, []), 4).count() == 0


def test_tiles_come_back(spark):
    df = events(spark, rand_events(5, 50))
    back = direction.combine(direction.subdivide(df, 3), 3)
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))


def edge_model(rows, w, h, voxel, length, directional):
    dense, undense = edges.thresholds(length, w * h)
    hop = length // 2
    state = {(x, y): -1 for x in range(w) for y in range(h)}
    out = []
    for i in range(length, len(rows), hop):
        n, vx, vy = {}, {}, {}
        for _, _, x, y, _, pol in rows[i - length : i]:
            c = (x // voxel, y // voxel)
            n[c] = n.get(c, 0) + 1
            vy[c] = vy.get(c, 0) + (pol == 0) - (pol == 2)
            vx[c] = vx.get(c, 0) + (pol == 1) - (pol == 3)
        new = {}
        for c, s in state.items():
            k = n.get(c, 0)
            v = 1 if s == -1 and k >= dense else -1 if k <= undense else s
            if v == 1 and s == -1 and directional:
                a, b = vx.get(c, 0), vy.get(c, 0)
                if a == 0:
                    code = 2 if b > 0 else 6
                else:
                    m = b / a
                    code = ((2, 3, 4, 5, 6) if a > 0 else (6, 7, 8, 9, 2))[sum(m >= q for q in (-2.5, -0.4, 0.4, 2.5))]
                dx, dy = edges.NEIGHBOUR[code]
                v = code if state.get((c[0] + dx, c[1] + dy), 0) >= 0 else 1
            if s >= 1:
                v = 0
            new[c] = v
        state = new
        out += [(x, y, s, i) for (x, y), s in state.items()]
    return sorted(out)


@pytest.mark.parametrize("directional", [False, True])
def test_edges(spark, directional):
    rng = random.Random(6)
    rows = [(k, k * 3, rng.choice([0, 1, rng.randrange(8)]) if k % 300 < 150 else rng.randrange(8), rng.randrange(8), 0, rng.randrange(4)) for k in range(1300)]
    f = edges.edge_states_directional if directional else edges.edge_states
    got = sorted((r["x"], r["y"], r["state"], r["index"]) for r in f(events(spark, rows), 4, 4, 2, 200).collect())
    assert got == edge_model(rows, 4, 4, 2, 200, directional)
    assert len({s for _, _, s, _ in got}) > 2
    assert f(events(spark, rows[:200]), 4, 4, 2, 200).count() == 0  # a window that ends at the last row is skipped


def dbscan_model(rows, eps_s, eps_t, min_pts, metric):
    n = len(rows)

    def near(a, b):
        dt, dx, dy = abs(a[1] - b[1]), abs(a[2] - b[2]), abs(a[3] - b[3])
        return (dx <= eps_s and dy <= eps_s and dt <= eps_t) if metric == "chebyshev" else dx * dx + dy * dy + (dt * (eps_s / eps_t)) ** 2 <= eps_s * eps_s

    nb = [[j for j in range(n) if near(rows[i], rows[j])] for i in range(n)]
    core = [len(v) >= min_pts for v in nb]
    label, c = [-1] * n, 0
    for i in range(n):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = c
            for a in todo:
                for b in nb[a]:
                    if core[b] and label[b] < 0:
                        label[b] = c
                        todo.append(b)
            c += 1
    for i in range(n):
        if not core[i]:
            label[i] = min((label[j] for j in nb[i] if core[j]), default=-1)
    return label


@pytest.mark.parametrize(("metric", "seed"), [("chebyshev", 1), ("euclidean", 2)])
def test_stdbscan(spark, metric, seed):
    rows = rand_events(seed, 260, 20, 20, 2000)
    df = events(spark, rows)
    want = dbscan_model(rows, 2.5, 150, 4, metric)
    got = {r["seq"]: r["cluster"] for r in density.stdbscan(df.repartition(5), 2.5, 150, 4, metric).collect()}
    assert [got[k] for k in range(len(rows))] == want and max(want) > 2
    whole = {r["seq"]: r["cluster"] for r in density.stdbscan(df, 2.5, 150, 4, metric, chunk=1000).collect()}
    assert whole == got
    with pytest.raises(ValueError, match="metric"):
        density.stdbscan(df, 1, 1, 2, "cosine")
    sizes = {columns.cell_size(df, 2.5, 150, most)[1] for most in (1, 1 << 16)}  # the span is halved down to the radius
    small = columns.cell_size(df, 2.5, 150, 1)
    assert len(sizes) == 2 and {tuple(r) for r in columns.degrees(df, 2.5, 150, metric, small).collect()} == {tuple(r) for r in density.degrees(df, 2.5, 150, metric).collect()}
    assert density.stdbscan(df.limit(0), 2.5, 150, 4, metric).count() == 0 and density.local_dbscan(pd.DataFrame({"x": [], "y": [], "t": []}), 1, 1, 1).tolist() == []


@pytest.mark.parametrize("metric", ["chebyshev", "euclidean"])
def test_core_links_go_with_cells(spark, metric):
    """Links between cells tell the components, and events that repeat add none."""
    rows = rand_events(3, 200, 40, 40, 3000)
    size = columns.cell_size(events(spark, rows), 6, 300, 1)
    counts = []
    for copies in (1, 5):
        many = [(seq + 1000 * k, *rest) for k in range(copies) for seq, *rest in rows]
        got = columns.core_links(events(spark, many), 6, 300, metric, size).collect()
        counts.append(sum(not r["own"] for r in got))
        assert sorted(r["b"] for r in got if r["own"]) == sorted(seq for seq, *_ in many)
        root = {seq: seq for seq, *_ in many}

        def top(k, root=root):
            while root[k] != k:
                k = root[k]
            return k

        for r in got:
            u, v = sorted((top(r["a"]), top(r["b"])))
            root[v] = u
        least: dict[int, int] = {}
        want = [least.setdefault(c, seq) for (seq, *_), c in zip(many, dbscan_model(many, 6, 300, 1, metric), strict=True)]
        assert [top(seq) for seq, *_ in many] == want and 5 < len(set(want)) < 150
    assert counts[0] == counts[1] > 0


def test_one_door(spark):
    df = events(spark, rand_events(1, 120, 9, 9))
    for method, options in (("stdbscan", {"eps_s": 3, "eps_t": 60, "min_pts": 4}), ("hdbscan", {"time_scale": 0.1, "min_cluster_size": 9}), ("meanshift", {"time_scale": 0.1, "bandwidth": 5.0}), ("dstream", {"tau": 99.0, "interval": 20, "verify": 0, "dense": 2.0, "medium": 1.0})):
        assert cluster.cluster_events(df, method, **options).where("cluster is not null").count() == 120
    with pytest.raises(ValueError, match="method"):
        cluster.cluster_events(df, "kmeans")


@pytest.mark.parametrize("most", [None, 2, 7, 5000])
def test_interval_join_bundles(spark, most):
    """Pairs of a brute force, with times of one row, of a few and of more than a group holds, and points on both ends."""
    rng = random.Random(5)
    times = [40] * 60 + [rng.randrange(-30, 120) for _ in range(90)] + [None]
    points = [(k, t, k % 2) for k, t in enumerate(times)]
    spans = [(900 + k, lo, lo + rng.choice((0, 1, 10, 35)), k % 2) for k, lo in enumerate([30] * 30 + [rng.randrange(-40, 110) for _ in range(50)])] + [(999, None, 50, 0), (998, 40, 10, 0)]
    p, s = spark.createDataFrame(points, "seq long, t long, k int"), spark.createDataFrame(spans, "span long, lo long, hi long, k int")
    want = sorted((k, a, t, n, lo, hi) for a, t, k in points for n, lo, hi, k2 in spans if k == k2 and None not in (t, lo) and lo < t <= hi)
    got = windows.interval_join(p, s, "t", "lo", "hi", 10, by=["k"], most=most).select("k", "seq", "t", "span", "lo", "hi")
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500
    none = windows.interval_join(p.where("seq < 0"), s.drop("k"), "t", "lo", "hi", 10, most=most)
    assert none.count() == 0 and none.columns.count("__b") == 0
    bare = windows.interval_join(p.select("t"), s.select("lo", "hi"), "t", "lo", "hi", 10, most=most)
    assert bare.count() == sum(lo < t <= hi for _, t, _ in points for _, lo, hi, _ in spans if None not in (t, lo))


def test_interval_join_in_bounds(spark):
    """Pairs of one bucket, and of one time, are made by many tasks."""
    p = spark.range(3000).select(F.col("id").alias("seq"), F.floor(F.col("id") / 9000).alias("t"))
    s = spark.range(2000).select(F.col("id").alias("span"), (F.floor(F.col("id") / 9000) - 1).alias("lo"), (F.floor(F.col("id") / 9000) + 9).alias("hi"))
    tasks = windows.interval_join(p, s, "t", "lo", "hi", 100, most=200).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 6_000_000 and len(tasks) > 50 and max(r["count"] for r in tasks) < 1_000_000


def test_interval_join_writes_copies_in_few_bytes(spark, tmp_path):
    """Rows of one time meet once, and the pairs of 40 copies take less than half the bytes."""
    p = spark.range(40 * 100).select(F.col("id").alias("seq"), (F.col("id") % 100 * 10).alias("t"))
    s = p.select(F.col("seq").alias("span"), (F.col("t") - 200).alias("lo"), F.col("t").alias("hi"))
    sizes = {}
    for most in (None, 4096):
        out = windows.interval_join(p, s, "t", "lo", "hi", 200, most=most).select("seq", "span")
        out.write.parquet(path := str(tmp_path / str(most)))
        sizes[most] = sum(f.stat().st_size for f in (tmp_path / str(most)).glob("*.parquet"))
        assert spark.read.parquet(path).count() == 40 * 40 * (100 * 20 - 190)
    assert sizes[4096] * 2 < sizes[None]


def test_chunked_stitches(spark):
    rows = [(k, 10 * k, 5 + (k // 7) % 2, 5, 0, 0) for k in range(90)] + [(200 + k, 2000 + 10 * k, 60, 9, 0, 0) for k in range(30)]
    got = {r["seq"]: r["cluster"] for r in density.stdbscan(events(spark, rows), 3, 50, 3, chunk=40, overlap=10).collect()}
    assert {got[k] for k in range(90)} == {0} and {got[200 + k] for k in range(30)} == {1}
    apart = {r["cluster"] for r in density.stdbscan(events(spark, rows), 3, 50, 3, chunk=40, overlap=10, max_centroid_dist=-1.0).collect()}
    assert len(apart) > 2  # a guard nothing passes
    with pytest.raises(ValueError, match="overlap"):
        density.stdbscan(events(spark, rows), 3, 50, 3, chunk=10, overlap=10)


def test_hdbscan(spark):
    rng = np.random.default_rng(1)
    x = np.vstack((rng.normal(0, 0.5, (60, 3)), rng.normal(9, 0.5, (50, 3)), rng.uniform(-30, 30, (12, 3))))
    for method in ("eom", "leaf"):
        label = hdbscan.local_hdbscan(x, 15, 5, method=method)
        assert len(set(label[:60]) - {-1}) >= 1 and set(label[:60]) - {-1} != set(label[60:110]) - {-1}
    label = hdbscan.local_hdbscan(x, 15, 5)
    assert (label[:60] == 0).mean() > 0.9 and (label[60:110] == 1).mean() > 0.9 and (label[110:] == -1).mean() > 0.7
    assert hdbscan.local_hdbscan(x[:3], 15).tolist() == [-1] * 3
    rows = [(k, int(1000 * p[2] + 50_000), int(2 * p[0] + 100), int(2 * p[1] + 100), 0, 0) for k, p in enumerate(x)]
    got = hdbscan.hdbscan(events(spark, rows), 500, 15, 5, chunk=200)
    assert got.count() == len(rows) and got.where("cluster >= 0").select("cluster").distinct().count() == 2


def blobs(n, seed):
    """Two dense groups, scattered events, and one place with many events."""
    r = np.random.default_rng(seed)
    p = np.vstack((r.normal(20, 2, (n // 3, 3)), r.normal(40, 3, (n // 3, 3)), r.uniform(0, 60, (n // 4, 3)), np.repeat(r.uniform(0, 60, (1, 3)), n // 12, 0)))
    return sorted(((k, int(1000 * q[2]), int(q[0]), int(q[1]), 0, 0) for k, q in enumerate(p)), key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize("case", [{}, {"cell": 16, "piece": 40, "small": 0, "epsilon": 5.0}, {"method": "leaf", "cell": 24}])
def test_hdbscan_of_a_whole_recording(spark, case, monkeypatch):
    """Against one hierarchy in one process: large cells and pieces, and small ones, so that every step takes several rounds."""
    if "small" in case:
        monkeypatch.setattr(hierarchy, "SALT", 16)  # crowded cells are asked in parts
    rows = blobs(216, len(case))
    x = np.column_stack(([r[2] for r in rows], [r[3] for r in rows], np.array([r[1] for r in rows]) / 1000.0)).astype(np.float32)
    want = hdbscan.local_hdbscan(x, 7, 4, **{k: v for k, v in case.items() if k in ("epsilon", "method")})
    got = {r["seq"]: r["cluster"] for r in hierarchy.cluster_whole(events(spark, rows), 1000.0, 7, 4, **case).collect()}
    assert [got[r[0]] for r in rows] == want.tolist() and len(set(want)) > 2


def test_hdbscan_of_few_rows(spark):
    few = events(spark, [(k, k, 1, 1, 0, 0) for k in range(4)])
    assert [r["cluster"] for r in hdbscan.hdbscan(few, 1.0, 5).collect()] == [-1] * 4
    assert hdbscan.hdbscan(few.limit(0), 1.0, 5).count() == 0
    assert {r["cluster"] for r in hdbscan.hdbscan(events(spark, [(k, 5, 1, 1, 0, 0) for k in range(30)]), 1.0, 5).collect()} == set(hdbscan.local_hdbscan(np.ones((30, 3)), 5).tolist())


def test_decayed_sums_and_last_values_over_slices(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, None]), t, k, rng.choice([None, rng.random()])) for k, t in enumerate(sorted(rng.choice([rng.randrange(300), 5000 + rng.randrange(300), 90_000]) for _ in range(400)))]
    df = spark.createDataFrame(rows, "k long, t long, seq long, v double")
    got = windows.decayed_sums(df, ["k"], "t", ["seq"], 7.0, {"m": F.lit(1.0), "s": F.coalesce("v", F.lit(0.0))}, {"t0": "t"})
    last = {r["seq"]: r["v2"] for r in windows.last_value(df, ["k"], "t", ["seq"], "v", "v2", 11).collect()}
    state, want = {}, {}
    for k, t, seq, v in rows:
        m, s, t0, known = state.get(k, (0.0, 0.0, None, None))
        d = math.exp(-(t - t0) / 7) if t0 is not None else 0.0
        known = v if v is not None else known
        state[k] = (m * d + 1, s * d + (v or 0.0), t, known)
        want[seq] = (*state[k][:2], t0)
        assert last[seq] == known
    assert all(r["t0"] == want[r["seq"]][2] and (r["m"], r["s"]) == pytest.approx(want[r["seq"]][:2], rel=1e-9) for r in got.collect()) and len(want) == got.count()


def test_meanshift(spark):
    rng = random.Random(2)
    rows = [(k, 1000 * (k % 20), int(rng.gauss(10 if k % 2 else 40, 1.5)), int(rng.gauss(10 if k % 2 else 30, 1.5)), 0, 0) for k in range(300)]
    for kernel in ("gaussian", "flat"):
        got = meanshift.meanshift(events(spark, rows), 1e4, 6.0, 5, 60, kernel, keep_all=True).collect()
        sides = {r["seq"] % 2: set() for r in got}
        for r in got:
            sides[r["seq"] % 2].add(r["cluster"])
        assert not sides[0] & sides[1] and len(sides[0]) == len(sides[1]) == 1
    assert meanshift.meanshift(events(spark, rows), 1e4, 6.0, 5).columns == ["x", "y", "t", "cluster"]
    assert meanshift.merge_modes([(0, 0, 0), (1, 0, 0), (9, 9, 9), (1.5, 0, 0)], 4) == [(2.5 / 3, 0.0, 0.0), (9.0, 9.0, 9.0)]
    assert meanshift.meanshift(events(spark, []), 1e4).count() == 0


def dstream_model(rows, c):
    den, last, grid, first, nxt, trig = {}, {}, {}, {}, 1, 0
    out = []
    for _, t, x, y, *_ in rows:
        g = (x // c.grid, y // c.grid)
        den[g] = den.get(g, 0.0) * math.exp(-(t - last.get(g, t)) / c.tau) + 1
        last[g] = t
        if t - trig >= c.interval:
            trig = t
            snap = {k: v * math.exp(-(t - last[k]) / c.tau) for k, v in den.items()}
            ok = {k for k, v in snap.items() if v >= c.medium}
            parts, seen = [], set()
            for k in sorted(ok, key=lambda k: (k[1], k[0])):
                if k in seen:
                    continue
                todo = [k]
                seen.add(k)
                for a in todo:
                    for dx, dy in itertools.product((-1, 0, 1), repeat=2):
                        b = (a[0] + dx, a[1] + dy)
                        if b in ok and b not in seen:
                            seen.add(b)
                            todo.append(b)
                if len(todo) >= c.min_cells and max(snap[a] for a in todo) >= c.dense:
                    parts.append(todo)
            claims, ids = {}, {}
            for n, part in enumerate(parts):
                votes = {}
                for a in part:
                    if grid.get(a):
                        votes[grid[a]] = votes.get(grid[a], 0) + 1
                if votes:
                    pid = min(votes, key=lambda i: (-votes[i], i))
                    if votes[pid] >= c.min_overlap or votes[pid] >= c.min_overlap_frac * len(part):
                        claims.setdefault(pid, []).append((-votes[pid], -len(part), n))
            for pid, v in claims.items():
                ids[min(v)[2]] = pid
            grid = {}
            for n, part in enumerate(parts):
                if n not in ids:
                    ids[n] = nxt
                    first[nxt] = t
                    nxt += 1
                grid |= dict.fromkeys(part, ids[n])
        pid = grid.get(g, 0)
        out.append(pid if den[g] >= c.medium and pid and t - first[pid] >= c.verify else -1)
    return out


@pytest.mark.parametrize("block", [1, 7, 50, 10_000])
def test_triggers_do_not_depend_on_blocks(spark, block):
    rng = random.Random(block)
    times = sorted(rng.choice([rng.randrange(3000), rng.randrange(900, 1100), 2000]) for _ in range(400))
    rows = [(k, t, 0, 0, 0, 0) for k, t in enumerate(times)]
    for interval in (10, 130, 5000):
        want, last = [], 0
        for k, t, *_ in rows:
            if t - last >= interval:
                last = t
                want.append((len(want) + 1, t, k))
        got = dstream.DStream(interval=interval).triggers(events(spark, rows), block).collect()
        assert sorted((r["frame"], r["t"], r["seq"]) for r in got) == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dstream(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(900):
        t = k * 40 + rng.randrange(40)
        x, y = (int(10 + 20 * math.sin(k / 150) + rng.gauss(0, 2)) % 40, 12) if k % 2 else (30, int(20 + 9 * math.cos(k / 90)) % 40)
        rows.append((k, t, x, y + rng.randrange(3), 0, 0))
    c = dstream.DStream(grid=4, tau=1500.0, dense=6.0, medium=2.5, interval=700, verify=900, min_cells=seed % 2 + 1, min_overlap=seed)
    got = {r["seq"]: r["cluster_id"] for r in c.cluster(events(spark, rows).repartition(3)).collect()}
    want = dstream_model(rows, c)
    assert [got[k] for k in range(len(rows))] == want and len(set(want)) > 2


def test_velocity(spark):
    rows = [(k, 10 * k, k, 2 * k, 0, 1) for k in range(1, 60)]
    df = events(spark, rows).withColumn("cluster_id", F.lit(3))
    got = velocity.estimate_velocities(df.unionByName(df.withColumn("cluster_id", F.lit(-1))), 100).orderBy("t").collect()
    assert [r["t"] for r in got] == list(range(110, 590, 100)) and {r["cluster_id"] for r in got} == {3}
    assert all(np.allclose(r["limit"], (0.1, 0.2)) for r in got) and all(r["votes"] == [1.0, 0.0] for r in got)
    # The sequential definitions of the two decaying estimates.
    m, com, v, prev, w = 0.0, (0.0, 0.0), (0.0, 0.0), None, [0.0, 0.0]
    path = {}
    for _, t, x, y, _, _ in rows:
        d = math.exp(-(t - prev) / 100) if prev is not None else 0.0
        m = m * d + 1
        new = tuple(((m - 1) * a + b) / m for a, b in zip(com, (x, y), strict=True)) if prev is not None else (float(x), float(y))
        inst = tuple((b - a) / (m * (t - prev)) for a, b in zip(com, (x, y), strict=True)) if prev is not None else (0.0, 0.0)
        v = tuple(((m - 1) * a + b) / m for a, b in zip(v, inst, strict=True))
        com, prev = new, t
        w = [w[0] * d + 1, w[1] * d]
        path[t] = (v, (w[0] / m, w[1] / m))
    for r in got:
        at = max(t for t in path if t <= r["t"])
        assert np.allclose(r["momentum"], path[at][0]) and np.allclose(r["decay_votes"], path[at][1])
    none = velocity.estimate_velocities(df, 100, pol=None).first()
    assert all(math.isnan(c) for c in none["votes"] + none["decay_votes"])
    assert velocity.estimate_velocities(df, 10_000).count() == 0
    ang = velocity.angular_error(velocity.estimate_velocities(df, 100), "votes").first()[0]
    assert abs(ang - math.degrees(math.atan2(2, 1))) < 1e-9
    assert abs(velocity.angular_jitter(velocity.estimate_velocities(df, 100), "votes").first()[0]) < 1e-9


def test_scores(spark):
    rng = random.Random(3)
    a = [(k, rng.randrange(4) - 1) for k in range(200)]
    b = [(k, v if rng.random() < 0.7 else rng.randrange(5)) for k, v in a]
    da, db = spark.createDataFrame(a, "seq long, l int"), spark.createDataFrame(b, "seq long, l int")
    got = evaluate.evaluate_clusters(da, db, "l", "l")
    agree = [(a[i][1] == a[j][1], b[i][1] == b[j][1]) for i in range(200) for j in range(i)]
    assert abs(got["rand"] - sum(p == q for p, q in agree) / len(agree)) < 1e-12
    assert got == pytest.approx(evaluate.evaluate_clusters(db, da, "l", "l"))
    assert 0 < got["ari"] < 1 and 0 < got["ami"] < got["nmi"] < 1
    same = evaluate.evaluate_clusters(da, da.withColumn("l", 7 - F.col("l")), "l", "l")
    assert same == pytest.approx({"rand": 1.0, "ari": 1.0, "nmi": 1.0, "ami": 1.0})
    # The expected mutual information is the mean over all permutations.
    la, lb = [0, 0, 1, 1, 1], [0, 1, 1, 2, 2]

    def mi(u, v):
        return sum(c / 5 * math.log(5 * c / (u.count(i) * v.count(j))) for i in set(u) for j in set(v) if (c := sum(p == i and q == j for p, q in zip(u, v, strict=True))))

    mean = sum(mi(la, list(p)) for p in itertools.permutations(lb)) / math.factorial(5)
    assert abs(evaluate.expected_mutual_information({2: 1, 3: 1}, {1: 1, 2: 2}, 5) - mean) < 1e-12
    with pytest.raises(ValueError, match="rows"):
        evaluate.contingency(da, db.limit(9), "l", "l")
    with pytest.raises(ValueError, match="method"):
        evaluate.evaluate_clusters(da, db, "l", "l", "f1")


def test_components(spark):
    rng = random.Random(4)
    pairs = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(300, 200 + k) for k in range(40)] + [(7, 7)]
    root = {}
    for a, b in pairs * 100:
        if a != b:
            root[a] = root[b] = min(root.get(a, a), root.get(b, b))
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long"), staged).collect()}
    assert got == root
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), staged).count() == 0


def test_components_contract(spark):
    """A path in order, a star around its greatest node, a random tree: the same components, in few rounds."""
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(400)] + [(2000, 1000 + k) for k in range(300)] + [(3000 + rng.randrange(k), 3000 + k) for k in range(1, 300)] + [(5000, 5000)]
    table, rounds = spark.createDataFrame(pairs, "a long, b long"), []
    want = {r["node"]: r["root"] for r in components.connected_components(table, staged).collect()}
    stage = lambda df, tag: rounds.append(tag) or staged(df, tag)
    for small in (0, 50):
        got = components.contracted_components(table, stage, small=small).collect()
        assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want) == 1002
    assert rounds.count("level") <= 12
    assert components.contracted_components(table.where("a = b"), staged).count() == 0


@pytest.mark.parametrize("shape", ["lattice", "spread", "dense"])
def test_short_forest_is_the_tree_up_to_a_radius(shape, monkeypatch):
    """Without a step for each row, unless most pairs lie within the radius."""
    rng = np.random.default_rng(7)
    x = {"lattice": np.floor(rng.random((300, 3)) * [6, 6, 9]), "spread": np.column_stack((np.floor(rng.random((300, 2)) * 6), rng.random(300) * 10)), "dense": rng.random((300, 3))}[shape]
    core = hdbscan.core_distances(x, 5)
    a, b, w = hdbscan.spanning_tree(x, core)
    if shape != "dense":
        monkeypatch.setattr(hdbscan, "spanning_tree", None)
    got = hdbscan.short_forest(x, core, 1.5)
    assert all(np.array_equal(g, v[w <= 1.5]) for g, v in zip(got, (a, b, w), strict=True)) and len(got[0]) > 100


def test_pairs_of_boxes_are_looked_at_by_groups():
    """One call for all pairs of a group; events that no lightest edge can have are left out, ties go to the least rows."""
    rng = np.random.default_rng(8)
    left, right, want = [], [], []
    for pair in range(30):
        a, b = (np.column_stack((np.floor(rng.random((n, 2)) * 6), np.floor(rng.random(n) * 9) + gap)) for n, gap in ((rng.integers(1, 150), 0), (rng.integers(1, 150), 11)))
        ra, rb = np.split(rng.permutation(len(a) + len(b)), [len(a)])
        ca, cb = rng.random(len(a)) * 3, rng.random(len(b)) * 3
        left += [(pair, 7, 100 + pair, int(r), *map(float, q), float(c)) for r, q, c in zip(ra, a, ca, strict=True)]
        right += [(pair, int(r), *map(float, q), float(c)) for r, q, c in zip(rb, b, cb, strict=True)]
        want.append(min((max(math.sqrt(sum((i - j) ** 2 for i, j in zip(p, q, strict=True))), c, d), int(min(r, s)), int(max(r, s))) for p, c, r in zip(a.tolist(), ca.tolist(), ra, strict=True) for q, d, s in zip(b.tolist(), cb.tolist(), rb, strict=True)))
    rng.shuffle(left)
    table = lambda rows, names: pa.table(dict(zip(names, zip(*rows, strict=True), strict=True)))
    got = hierarchy._all_lightest(table(left, ("pair", "ca", "cb", "row", "x", "y", "t", "core")), table(right, [f"{c}2" for c in ("pair", "row", "x", "y", "t", "core")]))
    assert [(r["w"], r["a"], r["b"]) for r in got.to_pylist()] == want and got.column("cb").to_pylist() == [100 + k for k in range(30)]


def test_positions_and_frames(spark):
    rows = rand_events(9, 300, span=90)
    got = {r["seq"]: r["pos"] for r in with_position(events(spark, rows).repartition(7)).collect()}
    assert got == {k: k for k in range(300)}
    even = events(spark, [(0, 0, 0, 0, 1, 0), (1, 50, 0, 0, 0, 0), (2, 100, 0, 0, 1, 0)])
    assert {(r["frame"], r["n"]) for r in frames.binary_frames(even, 50).collect()} == {(0, 1), (1, 1)}  # the last lies on the edge
    assert frames.binary_frames(events(spark, [(0, 5, 0, 0, 1, 0)] * 3), 50).count() == 0 and frames.binary_frames(events(spark, []), 50).count() == 0
    assert {(r["frame"], r["p"]) for r in frames.polarity_frames(even, 200).collect()} == {(0, 0)}


def test_joins_at_ties(spark):
    left = spark.createDataFrame([(0, 5, 1), (1, 10, 1), (2, 20, 2)], "seq long, t long, k int")
    right = spark.createDataFrame([(0, 10, 1, 7), (1, 10, 1, 8), (2, 15, 1, 9)], "seq long, t long, k int, v int")
    at = lambda strict: [r["v"] for r in windows.asof_join(left, right, ["k"], "t", "t", "v", strict).orderBy("seq").collect()]
    assert at(False) == [None, 8, None] and at(True) == [None, None, None]
    near = windows.nearest_join(spark.createDataFrame([(0, 12, 1), (1, 13, 1)], "seq long, t long, k int"), right.where("seq > 0").withColumnRenamed("t", "rt").drop("seq"), ["k"], "t", "rt", ["v"])
    assert [r["v"] for r in near.orderBy("seq").collect()] == [8, 9]
    tie = windows.nearest_join(spark.createDataFrame([(0, 12, 1)], "seq long, t long, k int"), spark.createDataFrame([(10, 1, 1), (14, 1, 2)], "rt long, k int, v int"), ["k"], "t", "rt", ["v"])
    assert tie.first()["v"] == 1


def test_expressions(spark):
    df = spark.createDataFrame([(-1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (0.0, -1.0), (1.0, -3.0), (1.0, 0.0), (-1.0, 3.0)], "vx double, vy double")
    assert [r[0] for r in df.select(expr.direction_code("vx", "vy")).collect()] == [8, 2, 6, 6, 2, 4, 6]
    assert expr.polarity_column(spark.createDataFrame([(1, 2)], "p int, pol int")) == "pol"
    with pytest.raises(ValueError, match="cluster"):
        expr.cluster_column(df)
    rgb = {r["id"]: tuple(r)[1:] for r in expr.palette(spark, [3, -1, 3, 5], {5: (1, 1, 1)}).collect()}
    assert rgb[-1] == (0, 0, 0) and rgb[5] == (1, 1, 1) and len(rgb) == 3
    v = spark.createDataFrame([([1.0, 2.0],), ([float("nan"), 1.0],), (None,)], "v array<double>")
    assert v.where(filters.valid_vector("v")).count() == 1


def test_time_cut_uses_the_uncut_maximum(spark):
    df = events(spark, [(k, 10 * k, 0, 0, 0, 0) for k in range(11)])
    assert [r["t"] for r in filters.time_cut(df).orderBy("t").collect()] == [20, 30]
    assert filters.time_range(df, 20, 60, 2).count() == 2 and filters.exclude_ids(df, "x", [0]).count() == 0


def test_nearest_join_by_slices(spark):
    """Against every pair, ties and one-sided keys included, in slices of several widths; nothing runs to the end of a key."""
    rng = random.Random(31)
    left = [(k, rng.randrange(300), rng.randrange(4)) for k in range(300)]
    right = sorted({(rng.randrange(-50, 350, 3), rng.randrange(3), rng.randrange(9)) for _ in range(120)})

    def nearest(t, k):
        return min(((abs(t - rt), rt, v) for rt, rk, v in right if rk == k), default=(0, None, None))[1:]

    want = sorted((s, t, k, *nearest(t, k)) for s, t, k in left)
    for width in (None, 1, 40, 1000):
        got = windows.nearest_join(spark.createDataFrame(left, "seq long, t long, k int"), spark.createDataFrame(right, "rt long, k int, v int"), ["k"], "t", "rt", ["v"], width)
        assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan and "__s" in plan


@pytest.mark.parametrize("least", [7, 25])
def test_repeated_places_are_single_nodes(spark, monkeypatch, least):
    """Places with more copies than neighbours are asked for: one event of each has edges, the labels are those of all events."""
    rng = random.Random(least)
    places = [(rng.randrange(12), rng.randrange(9), 1000 * rng.randrange(40)) for _ in range(60)]
    rows = [(k, t, x, y, 0, 0) for k, (x, y, t) in enumerate(sorted((p for p in places for _ in range(rng.choice([1, 3, 9, 30]))), key=lambda p: p[2]))]
    seen = []
    whole = hierarchy.candidate_edges
    monkeypatch.setattr(hierarchy, "candidate_edges", lambda points, *more: seen.append(points.groupBy("x", "y", "t").count().where("count > 5").count()) or whole(points, *more))
    got = {r["seq"]: r["cluster"] for r in hierarchy.cluster_whole(events(spark, rows), 1000.0, least, 4, piece=40).collect()}
    x = np.array([(x, y, t / 1000.0) for _, t, x, y, *_ in rows])
    assert [got[k] for k in range(len(rows))] == hdbscan.local_hdbscan(x, least, 4).tolist() and max(got.values()) > 0
    assert seen == [0] and len(got) == len(rows)
    assert {r["cluster"] for r in hierarchy.cluster_whole(events(spark, [(k, 5, 1, 1, 0, 0) for k in range(30)]), 1000.0, 7, 4).collect()} == set(hdbscan.local_hdbscan(np.ones((30, 3)), 7, 4).tolist())


def test_windows_of_repeated_places_cost_a_row_a_place(monkeypatch):
    """The tree by all rows, and as many distances as there are places."""
    rng = np.random.default_rng(8)
    x = np.repeat(rng.integers(0, 9, (40, 3)).astype(float), rng.choice([1, 2, 8, 20], 40), 0)
    x = x[rng.permutation(len(x))]
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, 1)[:, 5]
    root, want = list(range(n)), []
    for w, i, j in sorted((max(d[i, j], core[i], core[j]), i, j) for i in range(n) for j in range(i + 1, n)):
        if root[i] != root[j]:
            want.append((i, j, w))
            old = root[j]
            root = [root[i] if r == old else r for r in root]
    asked = []
    squares = hdbscan._squares
    monkeypatch.setattr(hdbscan, "_squares", lambda x, i: asked.append(i) or squares(x, i))
    got = hdbscan.core_distances(x, 5)
    assert np.array_equal(got, core) and len(asked) <= len(np.unique(x, axis=0))
    asked.clear()
    a, b, w = hdbscan.spanning_tree(x, core)
    assert list(zip(a.tolist(), b.tolist(), w.tolist(), strict=True)) == want
    assert len(asked) < n - (core == 0).sum() + len(np.unique(x[core == 0], axis=0)) + 1
