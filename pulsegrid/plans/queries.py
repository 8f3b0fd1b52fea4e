"""The queries of the event operators over cam_events, and their SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..model import CAM_SQL, cam_events, with_position
from ..operators import density, direction, dstream, edges, evaluate, filters, frames, hdbscan, meanshift, velocity, windows
from .staging import shared_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(cam_events(spark, sf_dir))
        if sql is not None:
            SQL[key] = f"with recursive {CAM_SQL.strip()}{sql}" if sql.lstrip().startswith(",") else f"with {CAM_SQL.strip()} {sql}"
        return f

    return add


def r6(c):
    return F.round(c, 6) + F.lit(0.0)  # no negative zero


def r9(c):
    """Half up by the double times 1e9, as SQL rounds; Spark's round goes by decimal digits, and blended colours end in a 5 there. For 0 to 1."""
    return F.floor(F.col(c) * 1e9 + 0.5) / 1e9


# --- filters and expressions ---------------------------------------------------------------------------------------


@query("select * from cam where t < (select max(t) from cam) * 2 / 5 and t > (select max(t) from cam) / 10")
def time_cut(cam):
    return filters.time_cut(cam)


@query("select * from cam where x >= 8 and x < 40 and y >= 4 and y < 20")
def spatial_crop(cam):
    return filters.spatial_crop(cam, 8, 40, 4, 20)


@query("select * from cam where obj <> -1")
def noise_drop(cam):
    return filters.drop_noise(cam, "obj")


@query("select * from cam where obj not in (1, 3, 5)")
def exclude_ids(cam):
    return filters.exclude_ids(cam, "obj", [1, 3, 5])


@query("select * from cam where pol = 2")
def polarity_subset(cam):
    return filters.polarity_subset(cam, 2)


@query("select seq, x::double as px, t / 1000.0::double as py, y::double as pz from (select * from cam where t >= 1000000 and t <= 100000000 order by t, seq limit 2000)")
def point_cloud_limit(cam):
    return frames.point_cloud(cam, t_start=1_000_000, t_end=100_000_000, max_points=2000)


@query("select seq, x + y::bigint * 64 as pix, x, y from cam")
def pixel_roundtrip(cam):
    lin = cam.select("seq", expr.linear_pixel("x", "y", 64).alias("pix"))
    return lin.select("seq", "pix", *expr.pixel_xy("pix", 64))


@query("select seq, (t::double * 0.001)::float::double as f_mult, (t::double * 0.0001)::float::double as f_div, (t::double * (7.0::double / 20000))::float::double as f_eps from cam")
def feature_matrix(cam):
    f = lambda s, n: expr.time_feature("t", s).cast("double").alias(n)
    return cam.select("seq", f(1e-3, "f_mult"), f(1 / 1e4, "f_div"), f(7 / 20000, "f_eps"))


@query("select seq, (x // 5)::int as gx, (y // 5)::int as gy from cam")
def grid_cells(cam):
    return cam.select("seq", *expr.grid_cell("x", "y", 5))


@query("select seq, greatest(0, least(9, trunc((x - 4) / 5.6)))::int as bx from cam")
def voxel_bins(cam):
    return cam.select("seq", expr.voxel_bin("x", 4, 60, 10).alias("bx"))


@query("select seq, (row_number() over (order by t, seq) - 1)::bigint as pos from cam where x >= 8 and x < 40")
def row_positions(cam):
    return with_position(cam.where("x >= 8 and x < 40")).select("seq", "pos")


_CODE = "case when vx = 0 then case when vy > 0 then 2 else 6 end when vx > 0 then case when vy / vx < -2.5 then 2 when vy / vx < -0.4 then 3 when vy / vx < 0.4 then 4 when vy / vx < 2.5 then 5 else 6 end else case when vy / vx < -2.5 then 6 when vy / vx < -0.4 then 7 when vy / vx < 0.4 then 8 when vy / vx < 2.5 then 9 else 2 end end"


@query(f"select seq, ({_CODE.replace('vx', '(x - 32)::double').replace('vy', '(y - 18)::double')})::int as code from cam")
def direction_code(cam):
    return cam.select("seq", expr.direction_code((F.col("x") - 32).cast("double"), (F.col("y") - 18).cast("double")).alias("code"))


# The first draws of the seeded generator, for the labels -1 (black) to 7.
_PALETTE = """
  (-1, 0.0, 0.0, 0.0),
  (0, 0.6973680290593639, 0.09417734788764953, 0.9756223516367559),
  (1, 0.761139701990353, 0.7860643052769538, 0.12811363267554587),
  (2, 0.45038593789556713, 0.37079802423258124, 0.9267649888486018),
  (3, 0.6438651200806645, 0.82276161327083, 0.44341419882733113),
  (4, 0.2272387217847769, 0.5545847870158348, 0.06381725610417532),
  (5, 0.8276311719925821, 0.6316643991220648, 0.7580877400853738),
  (6, 0.35452596812986836, 0.9706980243949033, 0.8931211213221977),
  (7, 0.7783834970737619, 0.19463870785196757, 0.4667210037270342)"""


@query(f"select p.id::bigint as id, p.r::double as r, p.g::double as g, p.b::double as b from (select distinct obj from cam) join (values {_PALETTE}) p(id, r, g, b) on p.id = obj")
def palette(cam):
    return expr.palette(cam.sparkSession, [r["obj"] for r in cam.select("obj").distinct().collect()])


# --- tiling and direction ------------------------------------------------------------------------------------------


@query("select seq, (y // 5)::int as py, (x // 5)::int as px, (y % 5)::int as ly, (x % 5)::int as lx from cam")
def patch_tiles(cam):
    return direction.subdivide(cam, 5).select("seq", "py", "px", "ly", "lx")


@query("select seq, t, (x // 5)::int as x, (y // 5)::int as y, pol from cam")
def patch_reduce(cam):
    return direction.reduce_to_patches(direction.subdivide(cam, 5)).select("seq", "t", "x", "y", "pol")


@query("select seq, t, x, y from cam")
def patch_combine(cam):
    return direction.combine(direction.subdivide(cam, 5), 5).select("seq", "t", "x", "y")


def _patches_sql(k: int) -> str:
    return f""", e as (select seq, t, (x // {k})::int as px, (y // {k})::int as py, (x % {k})::int as lx, (y % {k})::int as ly from cam),
lanes as (
  select *, 0 as dir, lx as lane, ly as v from e union all select *, 1, ly, lx from e
  union all select *, 2, lx, {k} - 1 - ly from e union all select *, 3, ly, {k} - 1 - lx from e),
nth as (select *, row_number() over (partition by py, px, dir, lane order by t, seq) as i from lanes),
run as (
  select *, case when v = 0 then 1 else 0 end as s from nth where i = 1
  union all
  select n.*, case when n.v = r.s % {k} then r.s % {k} + 1 when n.v > r.s % {k} then 0 else r.s % {k} end
  from run r join nth n on n.py = r.py and n.px = r.px and n.dir = r.dir and n.lane = r.lane and n.i = r.i + 1)"""


def _chains_sql(source: str) -> str:
    """Chains of two: `s` holds the patches (place * 4 + direction) that have begun one."""
    ahead = "(case when pol < 2 then 1 else -1 end)"
    return f""", o as (
  select *, pol % 2 as axis, case when pol % 2 = 0 then x else y end as lane, (case when pol % 2 = 0 then y else x end) * 4 as pos, 4 * {ahead} as one, (pol + 2) % 4 as rev,
    row_number() over (partition by pol % 2, case when pol % 2 = 0 then x else y end order by t, seq) as i from {source}),
chain as (
  select *, false as hit, [pos + pol] as s from o where i = 1
  union all
  select n.*, list_contains(c.s, n.pos - n.one + n.pol),
    case when list_contains(c.s, n.pos - n.one + n.pol) then list_filter(c.s, lambda e: e not in (n.pos + n.pol, n.pos - n.one + n.pol, n.pos + n.rev, n.pos + n.one + n.rev))
    else list_append(list_filter(c.s, lambda e: e not in (n.pos + n.pol, n.pos + n.rev, n.pos + n.one + n.rev)), n.pos + n.pol) end
  from chain c join o n on n.axis = c.axis and n.lane = c.lane and n.i = c.i + 1)"""


@query(_patches_sql(2) + " select seq, t, px as x, py as y, dir as pol from run where s = 2")
def patch_direction(cam):
    return direction.patch_direction(cam, 2)


# A sweep of two pixels that goes on from patch to patch ends at each far pixel that directly follows a near one.
_RASTER = _patches_sql(2)[: _patches_sql(2).index(",\nnth as")] + """, b as (select *, lag(v) over (partition by dir, lane order by py, px, t, seq) as before from lanes)
select seq, t, px as x, py as y, dir as pol from b where v = 1 and before = 0"""


@query(_RASTER)
def patch_direction_raster(cam):
    return direction.patch_direction(cam, 2, "raster")


@query(_chains_sql("(select seq, t, x, y, pol from cam)") + " select seq, t, x, y, pol from chain where hit")
def multipatch_direction(cam):
    return direction.multipatch_direction(cam.select("seq", "t", "x", "y", "pol"), 2)


def _writes_sql(source: str) -> str:
    return f""", r as ({source}),
w as (
  select t, seq, unnest(case pol
    when 0 then [{{'bx': x, 'by': y + 1, 'value': 1}}, {{'bx': x, 'by': y - 1, 'value': 0}}] when 1 then [{{'bx': x + 1, 'by': y, 'value': 1}}, {{'bx': x - 1, 'by': y, 'value': 0}}]
    when 2 then [{{'bx': x, 'by': y - 1, 'value': 1}}, {{'bx': x, 'by': y, 'value': 0}}] else [{{'bx': x - 1, 'by': y, 'value': 1}}, {{'bx': x, 'by': y, 'value': 0}}] end) as w from r)"""


def _mask_sql(k: int) -> str:
    return f""", l as (select w.bx as bx, w.by as by, t, arg_max(w.value, seq) as value from w group by all)
select c.seq, c.t, c.x, c.y, c.p from (select *, x // {k} as bx, y // {k} as by from cam) c asof join l on l.bx = c.bx and l.by = c.by and l.t < c.t
where l.value = 1 and c.t > (select min(t) from r) and c.t <= (select max(t) from r)"""


_BLOCKS = "select seq, t, (x // 4)::int as x, (y // 4)::int as y, pol from cam"


def _roi(cam):
    return cam.select("seq", "t", *expr.grid_cell("x", "y", 4), "pol").withColumnsRenamed({"gx": "x", "gy": "y"})


@query(_writes_sql(_BLOCKS) + " select w.bx, w.by, t, seq, w.value from w")
def roi_writes(cam):
    return direction.roi_writes(_roi(cam))


@query(_writes_sql(_BLOCKS) + _mask_sql(4))
def roi_filter(cam):
    return direction.apply_roi(cam.select("seq", "t", "x", "y", "p"), _roi(cam), 4)


@query(_patches_sql(2) + f", q as (select seq, t, px as x, py as y, dir as pol from run where s = 2){_chains_sql('q')}" + _writes_sql("select seq, t, x, y, pol from chain where hit") + _mask_sql(2))
def run_filter(cam):
    return direction.run_filter(cam.select("seq", "t", "x", "y", "p"), 2, 2)["out"]


# --- windows and joins ---------------------------------------------------------------------------------------------


@query("select c.seq, coalesce(r.x, -1)::int as rx from cam c asof left join (select t, x, obj from cam where pol = 0) r on c.obj = r.obj and r.t < c.t")
def asof_strict(cam):
    right = cam.where("pol = 0").select("t", "seq", "obj", F.col("x").alias("rx"))
    return windows.asof_join(cam.select("seq", "t", "obj"), right, ["obj"], "t", "t", "rx", strict=True).select("seq", F.coalesce("rx", F.lit(-1)).alias("rx"))


@query(
    """, r as (select t as rt, x as rx, obj from cam where pol = 0), b as (
  select c.seq, r.rt, r.rx, row_number() over (partition by c.seq order by abs(c.t - r.rt), r.rt) as k from cam c join r on r.obj = c.obj where c.pol = 1)
select seq, rt, rx from b where k = 1"""
)
def nearest_sample(cam):
    right = cam.where("pol = 0").select(F.col("t").alias("rt"), F.col("x").alias("rx"), "obj")
    return windows.nearest_join(cam.where("pol = 1").select("seq", "t", "obj"), right, ["obj"], "t", "rt", ["rx"]).select("seq", "rt", "rx")


@query("select c.seq, s.seq as span from cam c join (select * from cam where pol = 0) s on c.t > s.t - 500000 and c.t <= s.t")
def interval_join(cam):
    spans = cam.where("pol = 0").select(F.col("seq").alias("span"), (F.col("t") - 500_000).alias("lo"), F.col("t").alias("hi"))
    return windows.interval_join(cam.select("seq", "t"), spans, "t", "lo", "hi", 500_000, most=16_384).select("seq", "span")


@query(
    """, p as (select seq, row_number() over (order by t, seq) - 1 as pos from cam), n as (select count(*) as n from cam),
w as (select 1000 + 500 * range as i from range(0, 100000) , n where 1000 + 500 * range < n.n)
select w.i::bigint as index, count(*) as n, min(p.seq) as first_seq, max(p.seq) as last_seq from w join p on p.pos >= w.i - 1000 and p.pos < w.i group by w.i"""
)
def count_windows(cam):
    placed = with_position(cam)
    return windows.count_windows(placed, placed.count(), 1000).groupBy("index").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


# --- histograms and edges ------------------------------------------------------------------------------------------

_LATTICE = "select (range % 16)::int as cx, (range // 16)::int as cy from range(0, 144)"


@query(f"select l.cx, l.cy, coalesce(c.n, 0)::bigint as n from ({_LATTICE}) l left join (select x // 4 as cx, y // 4 as cy, count(*) as n from cam group by all) c using (cx, cy)")
def hist2d(cam):
    return edges.dense_counts(edges.cells(cam.drop("pol"), 0, 64, 0, 36, 16, 9), 16, 9)


@query("select (x // 4)::int as cx, (y // 4)::int as cy, count(*) as n, (count(*) filter (pol = 0) - count(*) filter (pol = 2))::bigint as vy, (count(*) filter (pol = 1) - count(*) filter (pol = 3))::bigint as vx from cam group by all")
def hist2d_direction(cam):
    return edges.counts(edges.cells(cam, 0, 64, 0, 36, 16, 9))


# Of the lattices that the table's own pixels make, for windows of a tenth of its events.
@query("""select w, round(l / p + 5 * sqrt(l * (p - 1) / (p * p)), 6) as dense, round(l / p - 2 * sqrt(l * (p - 1) / (p * p)), 6) as undense
from (select v as w, (select count(*) // 10 from cam)::double as l, count(distinct (x // v) * 1000 + y // v)::double as p from cam, (values (1), (2), (4), (8)) z(v) group by v)""")
def edge_thresholds(cam):
    length = cam.agg(F.floor(F.count("*") / 10)).first()[0]
    out = []
    for v in (1, 2, 4, 8):
        pixels = cam.select(expr.idiv("x", v), expr.idiv("y", v)).distinct().count()
        out.append((v, *map(float, edges.thresholds(length, pixels))))
    return cam.sparkSession.createDataFrame(out, "w int, dense double, undense double").select("w", r6("dense").alias("dense"), r6("undense").alias("undense"))


def _edges_sql(voxel: int, w: int, h: int, length: int, directional: bool) -> str:
    n = w * h
    dense, undense = (f"({length} / {n}.0::double {k} * sqrt({length} * {n - 1}.0::double / {n} / {n}))" for k in ("+ 5", "- 2"))
    hop = length // 2
    out = f""", p as (select x // {voxel} as cx, y // {voxel} as cy, pol, row_number() over (order by t, seq) - 1 as pos from cam where x < {w * voxel} and y < {h * voxel}),
n as (select count(*) as n from p),
l as (select range % {w} as cx, (range // {w}) % {h} as cy, range // {w * h} as m from range(0, 200 * {w * h}), n where {length} + {hop} * (range // {w * h}) < n.n),
c as (
  select l.m, l.cx, l.cy, count(p.pos) as k, (count(*) filter (p.pol = 0) - count(*) filter (p.pol = 2))::double as vy, (count(*) filter (p.pol = 1) - count(*) filter (p.pol = 3))::double as vx
  from l left join p on p.cx = l.cx and p.cy = l.cy and p.pos >= l.m * {hop} and p.pos < l.m * {hop} + {length} group by l.m, l.cx, l.cy),
s as (
  select c.*, -1 as old, case when k >= {dense} then 1 else -1 end as state from c where m = 0
  union all
  select c.*, s.state, case when s.state = 1 then 0 when s.state = -1 and c.k >= {dense} then 1 when c.k <= {undense} then -1 else s.state end
  from s join c on c.m = s.m + 1 and c.cx = s.cx and c.cy = s.cy)"""
    if not directional:
        return out + f" select cx::int as x, cy::int as y, state::int as state, (m * {hop} + {length})::bigint as index from s"
    nx = "case code when 3 then -1 when 4 then -1 when 5 then -1 when 7 then 1 when 8 then 1 when 9 then 1 else 0 end"
    ny = "case code when 2 then -1 when 3 then -1 when 9 then -1 when 5 then 1 when 6 then 1 when 7 then 1 else 0 end"
    return (
        out
        + f""", d as (select *, {_CODE} as code from s)
select d.cx::int as x, d.cy::int as y, (case when d.state = 1 then case when coalesce(o.old, 0) >= 0 then d.code else 1 end else d.state end)::int as state, (d.m * {hop} + {length})::bigint as index
from d left join d o on o.m = d.m and o.cx = d.cx + ({nx.replace("code", "d.code")}) and o.cy = d.cy + ({ny.replace("code", "d.code")})"""
    )


@query(_edges_sql(8, 8, 4, 2000, False))
def edge_states(cam):
    return edges.edge_states(cam, 8, 4, 8, 2000)


@query(_edges_sql(8, 8, 4, 2000, True))
def edge_states_directional(cam):
    return edges.edge_states_directional(cam, 8, 4, 8, 2000)


# --- clustering ----------------------------------------------------------------------------------------------------


@query("select obj, count(*) as n_events, min(x) as x_min, max(x) as x_max, min(y) as y_min, max(y) as y_max, min(t) as t_min, max(t) as t_max, max(t) - min(t) as t_span from cam group by obj")
def cluster_summary(cam):
    return density.cluster_summary(cam, "obj")


@query("select count(distinct obj) filter (obj <> -1) as clusters, (count(*) filter (obj = -1))::bigint as noise, round(100.0 * count(*) filter (obj = -1) / count(*), 6)::double as noise_percent from cam")
def label_counts(cam):
    return evaluate.label_counts(cam, "obj").withColumn("noise_percent", r6("noise_percent"))


_NEAR = "abs(a.x - b.x) <= 2 and abs(a.y - b.y) <= 2 and abs(a.t - b.t) <= 5000000"


@query(f"select a.seq, count(*) as degree from cam a join cam b on {_NEAR} group by a.seq")
def stdbscan_degree(cam):
    return density.degrees(cam, 2, 5_000_000)


def _dbscan_sql(near: str) -> str:
    return f""", pairs as materialized (select a.seq as a, b.seq as b from cam a join cam b on {near}),
core as materialized (select a as seq from pairs group by a having count(*) >= 8),
ee as materialized (select p.a, p.b from pairs p join core c on c.seq = p.a join core d on d.seq = p.b),
reach(node, root) as (select seq, seq from core union select e.b, r.root from reach r join ee e on e.a = r.node and e.b > r.root),
roots as (select node, min(root) as root from reach group by node),
numbered as (select node, (dense_rank() over (order by root) - 1)::int as c from roots)
select cam.seq, coalesce(n.c, (select min(m.c) from pairs p join numbered m on m.node = p.a where p.b = cam.seq), -1)::int as cluster
from cam left join numbered n on n.node = cam.seq"""


@query(_dbscan_sql(_NEAR))
def stdbscan(cam):
    return density.stdbscan(cam, 2, 5_000_000, 8).select("seq", "cluster")


@query(_dbscan_sql("(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + pow(abs(a.t - b.t) * (2.9::double / 5000000), 2) <= 2.9::double * 2.9::double"))
def stdbscan_euclid(cam):
    return density.stdbscan(cam, 2.9, 5_000_000, 8, "euclidean").select("seq", "cluster")


_CHUNKED = f""", p as (select seq, x, y, t, row_number() over (order by t, seq) - 1 as pos from cam),
win as materialized (select p.*, unnest(range(greatest(0, (pos - 2999 + 2399) // 2400), pos // 2400 + 1)) as w from p),
pairs as materialized (select a.w, a.pos as a, b.pos as b from win a join win b on a.w = b.w and {_NEAR}),
core as materialized (select w, a as pos from pairs group by all having count(*) >= 8),
ee as materialized (select p.w, p.a, p.b from pairs p join core c on c.w = p.w and c.pos = p.a join core d on d.w = p.w and d.pos = p.b),
reach(w, node, root) as (select w, pos, pos from core union select e.w, e.b, r.root from reach r join ee e on e.w = r.w and e.a = r.node and e.b > r.root),
roots as (select w, node, min(root) as root from reach group by w, node),
numbered as materialized (select w, node as pos, dense_rank() over (partition by w order by root) - 1 as local from roots),
found as materialized (
  select w, pos, local from numbered
  union all
  select p.w, p.b, min(m.local) from pairs p join numbered m on m.w = p.w and m.pos = p.a where (p.w, p.b) not in (select (w, pos) from core) group by p.w, p.b),
edges as materialized (select distinct a.w * 3000 + a.local as u, b.w * 3000 + b.local as v from found a join found b on b.w = a.w + 1 and b.pos = a.pos),
ways as materialized (select u, v from edges union select v, u from edges),
joined(node, root) as (select distinct w * 3000 + local, w * 3000 + local from found union select e.v, j.root from joined j join ways e on e.u = j.node and e.v > j.root),
own as (select f.pos, j.root from found f join (select node, min(root) as root from joined group by node) j on j.node = f.w * 3000 + f.local where f.pos // 2400 = f.w),
named as (select pos, dense_rank() over (order by root) - 1 as c from own)
select p.seq, coalesce(n.c, -1)::int as cluster from p left join named n on n.pos = p.pos"""


@query(_CHUNKED)
def stdbscan_chunked(cam):
    return density.stdbscan(cam, 2, 5_000_000, 8, chunk=3000).select("seq", "cluster")


@query(name="hdbscan")
def hdbscan_whole(cam):
    return hdbscan.hdbscan(cam, 1e6, 20, 10).select("seq", "cluster")


@query()
def hdbscan_chunked(cam):
    return hdbscan.hdbscan(cam, 1e6, 20, 10, chunk=1500, overlap=300).select("seq", "cluster")


@query("select round(pow(4.0::double / 5, 1.0::double / 7) * pow(count(*), -1.0::double / 7) * (stddev_pop(x::float::double) + stddev_pop(y::float::double) + stddev_pop((t::double / 1e6)::float::double)) / 3, 6) as bandwidth from cam")
def silverman(cam):
    bw = meanshift.silverman_bandwidth(meanshift.features(cam, 1e6))
    return cam.sparkSession.createDataFrame([(round(bw, 6),)], "bandwidth double")


@query("select floor(x::float::double / 12)::bigint as bx, floor(y::float::double / 12)::bigint as by, floor((t::double / 1e6)::float::double / 12)::bigint as bt, count(*) as n from cam group by all having count(*) >= 10")
def bin_seeds(cam):
    return meanshift.bin_seeds(meanshift.features(cam, 1e6), 12, 10).select("bx", "by", "bt", "n")


@query(
    """, f as (select x::float::double as fx, y::float::double as fy, (t::double / 1e6)::float::double as ft from cam),
s as (select (floor(fx / 12) + 0.5) * 12 as sx, (floor(fy / 12) + 0.5) * 12 as sy, (floor(ft / 12) + 0.5) * 12 as st from f group by all having count(*) >= 35),
w as (select s.*, f.*, exp(-((fx - sx) * (fx - sx) + (fy - sy) * (fy - sy) + (ft - st) * (ft - st)) / 288) as w from s, f)
select round(sx, 6)::double as sx, round(sy, 6)::double as sy, round(st, 6)::double as st, round(sum(w * fx) / sum(w), 6) as mx, round(sum(w * fy) / sum(w), 6) as my, round(sum(w * ft) / sum(w), 6) as mt from w group by sx, sy, st"""
)
def meanshift_step(cam):
    f = meanshift.features(cam, 1e6)
    seeds = [(r["sx"], r["sy"], r["st"]) for r in meanshift.bin_seeds(f, 12, 35).collect()]
    rows = [(*a, *b) for a, b in zip(seeds, meanshift.shift_once(f, seeds, 12), strict=True)]
    names = ("sx", "sy", "st", "mx", "my", "mt")
    return cam.sparkSession.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).select(*(r6(n).alias(n) for n in names))


def _meanshift_sql(flat: bool) -> str:
    """Bandwidth 24, bins of 10 events or more, at most 15 shifts of all seeds; then centres in order, each covering what
    is near it, and the nearest centre of each event."""
    d2 = lambda a, b: " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in ("x", "y", "t"))
    weight = f"case when {d2('f', 'i')} <= 576 then 1.0::double end" if flat else f"exp(-({d2('f', 'i')}) / 1152)"
    modes = (
        f"select row_number() over (order by n desc, x desc, y desc, t desc) as id, x, y, t from (select m.x, m.y, m.t, count(*) as n from (select distinct x, y, t from last) m join f on {d2('f', 'm')} <= 576 group by all)"
        if flat
        else "select id, x, y, t from last"
    )
    near = f"{d2('a', 'b')} <= 576" if flat else f"a.id = b.id or 4 * ({d2('a', 'b')}) < 576"
    centre = "select l.n, m.x, m.y, m.t from leads l join modes m on m.id = l.id" if flat else "select l.n, avg(m.x) as x, avg(m.y) as y, avg(m.t) as t from leads l join nb on nb.id = l.id join modes m on list_contains(nb.ids, m.id) group by l.n"
    return f""", f as materialized (select seq, x::float::double as x, y::float::double as y, (t::double / 1e6)::float::double as t from cam),
i(k, id, x, y, t, far) as (
  select 0, row_number() over (order by gx, gy, gt), (gx + 0.5) * 24, (gy + 0.5) * 24, (gt + 0.5) * 24, 1e9::double
  from (select floor(x / 24) as gx, floor(y / 24) as gy, floor(t / 24) as gt from f group by all having count(*) >= 10)
  union all
  select k + 1, id, nx, ny, nt, max(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y) + (nt - t) * (nt - t))) over ()
  from (
    select i.k, i.id, i.x, i.y, i.t, coalesce(sum(w * fx) / sum(w), i.x) as nx, coalesce(sum(w * fy) / sum(w), i.y) as ny, coalesce(sum(w * ft) / sum(w), i.t) as nt
    from (select i.*, f.x as fx, f.y as fy, f.t as ft, {weight} as w from i, f where i.k < 15 and i.far >= 0.024) i group by i.k, i.id, i.x, i.y, i.t)),
last as materialized (select id, x, y, t from i where k = (select max(k) from i)),
modes as materialized ({modes}),
nb as materialized (select a.id, list(b.id) as ids from modes a join modes b on {near} group by a.id),
every as (select list(id order by id) as ids from modes),
leads(n, id, covered) as (
  select 0, id, ids from nb where id = 1
  union all
  select l.n + 1, nb.id, list_concat(l.covered, nb.ids)
  from (select leads.*, list_min(list_filter(every.ids, lambda e: not list_contains(leads.covered, e))) as next from leads, every) l join nb on nb.id = l.next),
centres as ({centre}),
best as (select f.seq, arg_min(c.n, ({d2('f', 'c')}, c.n)) as n from f, centres c group by f.seq)
select cam.x, cam.y, cam.t, best.n::int as cluster from cam join best using (seq)"""


@query(_meanshift_sql(False), name="meanshift")
def meanshift_(cam):
    return meanshift.meanshift(cam, 1e6, 24, 10, 15)


@query(_meanshift_sql(True))
def meanshift_flat(cam):
    return meanshift.meanshift(cam, 1e6, 24, 10, 15, kernel="flat")


_DS = dstream.DStream(grid=8, tau=5e6, dense=9, medium=6, interval=1_000_000, verify=2_000_000)


@query("select a.seq, round(sum(exp(-(a.t - b.t) / 5e6::double)), 6) as d from cam a join cam b on a.x // 8 = b.x // 8 and a.y // 8 = b.y // 8 and (b.t < a.t or (b.t = a.t and b.seq <= a.seq)) group by a.seq")
def dstream_density(cam):
    return _DS.densities(cam).select("seq", r6("d").alias("d"))


_TRIGGERS = """, e as materialized (select seq, t from cam), f as (select min((t, seq)) as m from e where t >= 1000000),
tr(k, t, seq) as (
  select 1, struct_extract(m, 1), struct_extract(m, 2) from f where m is not null
  union all
  select k + 1, struct_extract(n, 1), struct_extract(n, 2) from (select tr.k, (select min((e.t, e.seq)) from e where e.t >= tr.t + 1000000) as n from tr) where n is not null)"""


@query(_TRIGGERS + " select k::bigint as frame, t, seq from tr")
def dstream_triggers(cam):
    return _DS.triggers(cam)


# Cells are numbered in raster order; `ids` goes from frame to frame, with a row of local 0 that holds the next free id.
_STREAMED = (
    _TRIGGERS
    + """, cells as materialized (select seq, t, x // 8 as gx, y // 8 as gy from cam),
snap as materialized (
  select tr.k as frame, tr.t, c.gy * 1000 + c.gx as cell, sum(exp(-(tr.t - c.t) / 5e6::double)) as d
  from tr join cells c on c.t < tr.t or (c.t = tr.t and c.seq <= tr.seq) group by all having sum(exp(-(tr.t - c.t) / 5e6::double)) >= 6),
reach(frame, cell, root) as (
  select frame, cell, cell from snap
  union select r.frame, s.cell, r.root from reach r join snap s on s.frame = r.frame and s.cell > r.root and abs(s.cell // 1000 - r.cell // 1000) <= 1 and abs(s.cell % 1000 - r.cell % 1000) <= 1),
roots as (select frame, cell, min(root) as root from reach group by frame, cell),
parts as materialized (
  select r.frame, r.root, count(*) as area, row_number() over (partition by r.frame order by r.root) as local
  from roots r join snap s on s.frame = r.frame and s.cell = r.cell group by r.frame, r.root having max(s.d) >= 9),
comp as materialized (select r.frame, r.cell, p.local, p.area from roots r join parts p on p.frame = r.frame and p.root = r.root),
claims as materialized (
  select k as frame, 0 as local, 0 as area, 0 as prev, 0 as n from tr
  union all select frame, local, area, 0, 0 from parts
  union all select a.frame, a.local, a.area, b.local, count(*) from comp a join comp b on b.frame = a.frame - 1 and b.cell = a.cell group by all),
ids(frame, local, id, next) as (
  select 0, 0, 0, 1
  union all
  select frame, local, case when local = 0 then 0 when mine then pid else next + fresh - 1 end, next + every
  from (
    select *, sum(case when local > 0 and not mine then 1 else 0 end) over (order by local) as fresh, sum(case when local > 0 and not mine then 1 else 0 end) over () as every
    from (
      select *, n > 0 and row_number() over (partition by pid order by n desc, area desc, local) = 1 as mine
      from (
        select c.frame, c.local, c.area, c.n, i.id as pid, i.next, row_number() over (partition by c.local order by c.n desc, i.id) as nth
        from ids i join claims c on c.frame = i.frame + 1 and c.prev = i.local)
      where nth = 1))),
first as (select i.id, min(tr.t) as t from ids i join tr on tr.k = i.frame where i.local > 0 group by i.id),
dens as (select a.seq, sum(exp(-(a.t - b.t) / 5e6::double)) as d from cells a join cells b on a.gx = b.gx and a.gy = b.gy and (b.t < a.t or (b.t = a.t and b.seq <= a.seq)) group by a.seq),
held as (select c.seq, c.t, c.gy * 1000 + c.gx as cell, tr.k as frame from cells c asof join tr on c.seq >= tr.seq),
named as (
  select h.seq, i.id from held h join dens using (seq) join comp p on p.frame = h.frame and p.cell = h.cell join ids i on i.frame = p.frame and i.local = p.local join first f on f.id = i.id
  where dens.d >= 6 and h.t - f.t >= 2000000)
select cam.seq, coalesce(n.id, -1)::bigint as cluster_id from cam left join named n on n.seq = cam.seq"""
)


@query(_STREAMED, name="dstream")
def dstream_(cam):
    return _DS.cluster(cam).select("seq", "cluster_id")


# --- velocity ------------------------------------------------------------------------------------------------------

_DT = 5_000_000
_GRID = f""", ends as (select obj, min(t) as a, max(t) as b from cam where obj <> -1 group by obj),
g as (select obj, m, a + m * {_DT} as t from (select obj, a, unnest(range(1, ((b - a) + {_DT - 1}) // {_DT})) as m from ends)),
e as (select c.*, (c.t - ends.a) // {_DT} as b from cam c join ends using (obj))"""


def _flat(df: DataFrame, name: str) -> DataFrame:
    v = lambda i: F.nanvl(F.col(name)[i], F.lit(None).cast("double"))
    return df.select("obj", "t", r6(v(0)).alias("vx"), r6(v(1)).alias("vy"))


def _moving(cam):
    return cam.where("obj <> -1").withColumn("obj", F.col("obj").cast("long"))


@query(_GRID + " select obj::bigint as obj, t from g")
def vel_grid(cam):
    return velocity.grid(_moving(cam), _DT, "obj").select("obj", "t")


@query(
    _GRID
    + """, c as (select obj, b, avg(x) as x, avg(y) as y, avg(t) as mt from e group by obj, b)
select g.obj::bigint as obj, g.t, round((h.x - l.x) / (h.mt - l.mt) * 1e6, 6) as vx, round((h.y - l.y) / (h.mt - l.mt) * 1e6, 6) as vy
from g left join c l on l.obj = g.obj and l.b = g.m - 1 left join c h on h.obj = g.obj and h.b = g.m"""
)
def vel_limit(cam):
    out = velocity.limit_velocity(_moving(cam), _DT, "obj")
    return _flat(out.withColumn("limit", F.transform("limit", lambda v: v * 1e6)), "limit")


@query(
    _GRID
    + """, c as (select obj, b, count(*) as n, count(*) filter (pol = 1) - count(*) filter (pol = 3) as u, count(*) filter (pol = 0) - count(*) filter (pol = 2) as v from e group by obj, b)
select g.obj::bigint as obj, g.t, round(u / n::double, 6) as vx, round(v / n::double, 6) as vy from g left join c on c.obj = g.obj and c.b = g.m - 1"""
)
def vel_votes(cam):
    return _flat(velocity.votes_velocity(_moving(cam), _DT, "obj"), "votes")


@query(
    _GRID
    + f""", d as (
  select g.obj, g.t, sum(exp((e.t - g.t) / {_DT}::double)) as m,
    sum(exp((e.t - g.t) / {_DT}::double) * (case pol when 1 then 1 when 3 then -1 else 0 end)) as u, sum(exp((e.t - g.t) / {_DT}::double) * (case pol when 0 then 1 when 2 then -1 else 0 end)) as v
  from g join e on e.obj = g.obj and e.t <= g.t group by g.obj, g.t)
select obj::bigint as obj, t, round(u / m, 6) as vx, round(v / m, 6) as vy from d"""
)
def vel_decay_votes(cam):
    return _flat(velocity.decay_votes_velocity(_moving(cam), _DT, "obj"), "decay_votes")


_MOMENTUM = f""", o as materialized (select obj, t, x, y, row_number() over (partition by obj order by t, seq) as i from cam where obj <> -1),
mo as (
  select obj, i, t, 1.0::double as m, x::double as cx, y::double as cy, 0.0::double as vx, 0.0::double as vy from o where i = 1
  union all
  select obj, i, t, m, ((m - 1) * cx + x) / m, ((m - 1) * cy + y) / m, ((m - 1) * vx + case when gap = 0 then 0 else (x - cx) / (m * gap) end) / m, ((m - 1) * vy + case when gap = 0 then 0 else (y - cy) / (m * gap) end) / m
  from (select o.obj, o.i, o.t, o.x, o.y, mo.cx, mo.cy, mo.vx, mo.vy, o.t - mo.t as gap, mo.m * exp(-(o.t - mo.t) / {_DT}::double) + 1 as m from mo join o on o.obj = mo.obj and o.i = mo.i + 1)),
momentum as (select g.obj, g.t, arg_max(mo.vx, mo.i) as vx, arg_max(mo.vy, mo.i) as vy from g join mo on mo.obj = g.obj and mo.t <= g.t group by g.obj, g.t)"""


@query(_GRID + _MOMENTUM + " select obj::bigint as obj, t, round(vx, 6) + 0.0::double as vx, round(vy, 6) + 0.0::double as vy from momentum")
def vel_momentum(cam):
    return _flat(velocity.momentum_velocity(_moving(cam), _DT, "obj"), "momentum")


def _both(cam):
    m = _moving(cam)
    return velocity.limit_velocity(m, _DT, "obj").join(velocity.votes_velocity(m, _DT, "obj"), ["obj", "t"])


_ANGLES = (
    _GRID
    + """, c as (select obj, b, avg(x) as x, avg(y) as y, avg(t) as mt, count(*) as n, count(*) filter (pol = 1) - count(*) filter (pol = 3) as u, count(*) filter (pol = 0) - count(*) filter (pol = 2) as v from e group by obj, b),
r as (
  select g.obj, g.t, (h.x - l.x) / (h.mt - l.mt) as lx, (h.y - l.y) / (h.mt - l.mt) as ly, l.u / l.n::double as mx, l.v / l.n::double as my
  from g join c l on l.obj = g.obj and l.b = g.m - 1 join c h on h.obj = g.obj and h.b = g.m)"""
)


@query(
    _ANGLES
    + """ select round(avg(e), 6) as angular_error from (
  select obj, avg(case when sqrt(lx * lx + ly * ly) > 1e-6 and sqrt(mx * mx + my * my) > 1e-6 then degrees(acos(greatest(-1.0::double, least(1.0::double, (lx * mx + ly * my) / (sqrt(lx * lx + ly * ly) * sqrt(mx * mx + my * my)))))) end) as e
  from r group by obj having count(*) >= 2)"""
)
def vel_angular_error(cam):
    return velocity.angular_error(_both(cam), "votes", "obj").select(r6("angular_error").alias("angular_error"))


@query(
    _ANGLES
    + """, q as (select *, lag(mx) over w as bx, lag(my) over w as byy, count(*) over (partition by obj) as n from r window w as (partition by obj order by t))
select round(avg(j), 6) as angular_jitter from (
  select obj, avg(case when sqrt(bx * bx + byy * byy) > 1e-6 and sqrt(mx * mx + my * my) > 1e-6 then degrees(acos(greatest(-1.0::double, least(1.0::double, (bx * mx + byy * my) / (sqrt(bx * bx + byy * byy) * sqrt(mx * mx + my * my)))))) end) as j
  from q where n >= 2 and bx is not null group by obj)"""
)
def vel_angular_jitter(cam):
    return velocity.angular_jitter(_both(cam), "votes", "obj").select(r6("angular_jitter").alias("angular_jitter"))


@query(
    _GRID
    + _MOMENTUM
    + f""", c as (select obj, b, avg(x) as x, avg(y) as y, avg(t) as mt, count(*) as n, count(*) filter (pol = 1) - count(*) filter (pol = 3) as u, count(*) filter (pol = 0) - count(*) filter (pol = 2) as v from e group by obj, b),
d as (
  select g.obj, g.t, sum(exp((e.t - g.t) / {_DT}::double)) as m,
    sum(exp((e.t - g.t) / {_DT}::double) * (case pol when 1 then 1 when 3 then -1 else 0 end)) as u, sum(exp((e.t - g.t) / {_DT}::double) * (case pol when 0 then 1 when 2 then -1 else 0 end)) as v
  from g join e on e.obj = g.obj and e.t <= g.t group by g.obj, g.t)
select g.obj::bigint as obj, g.t, round((h.x - l.x) / (h.mt - l.mt), 6) + 0.0::double as limit_vx, round((h.y - l.y) / (h.mt - l.mt), 6) + 0.0::double as limit_vy,
  round(k.vx, 6) + 0.0::double as momentum_vx, round(k.vy, 6) + 0.0::double as momentum_vy, round(l.u / l.n::double, 6) as votes_vx, round(l.v / l.n::double, 6) as votes_vy,
  round(d.u / d.m, 6) as decay_votes_vx, round(d.v / d.m, 6) as decay_votes_vy
from g left join c l on l.obj = g.obj and l.b = g.m - 1 left join c h on h.obj = g.obj and h.b = g.m left join momentum k on k.obj = g.obj and k.t = g.t left join d on d.obj = g.obj and d.t = g.t"""
)
def estimate_velocities(cam):
    out = velocity.estimate_velocities(cam, _DT, "obj")
    return out.select("obj", "t", *(r6(F.nanvl(F.col(m)[i], F.lit(None).cast("double"))).alias(f"{m}_{c}") for m in velocity.METHODS for i, c in enumerate(("vx", "vy"))))


# --- evaluation ----------------------------------------------------------------------------------------------------

_SCORES = """, n as (select obj as a, (x // 16)::int as b, count(*)::double as n from cam group by all),
ra as (select a, sum(n) as k from n group by a), rb as (select b, sum(n) as k from n group by b),
s as (
  select (select sum(n) from n) as n, (select sum(n * (n - 1) / 2) from n) as p, (select sum(k * (k - 1) / 2) from ra) as pa, (select sum(k * (k - 1) / 2) from rb) as pb,
    (select sum(n * ln(n)) from n) as e, (select sum(k * ln(k)) from ra) as ea, (select sum(k * ln(k)) from rb) as eb),
h as (select *, n * (n - 1) / 2 as t, ln(n) - ea / n as ha, ln(n) - eb / n as hb, ln(n) - ea / n + ln(n) - eb / n - (ln(n) - e / n) as mi from s)"""


def _score(cam, method):
    other = cam.select("seq", (F.col("x") / 16).cast("int").alias("col"))
    v = evaluate.evaluate_clusters(cam.select("seq", "obj"), other, "obj", "col", method)[method]
    return cam.sparkSession.createDataFrame([(round(v, 6) + 0.0,)], "score double")  # no negative zero


@query(_SCORES + " select round((t + 2 * p - pa - pb) / t, 6) as score from h")
def rand_index(cam):
    return _score(cam, "rand")


@query(_SCORES + " select round((p - pa * pb / t) / ((pa + pb) / 2 - pa * pb / t), 6) + 0.0::double as score from h")
def adjusted_rand(cam):
    return _score(cam, "ari")


@query(_SCORES + " select round(mi / ((ha + hb) / 2), 6) + 0.0::double as score from h")
def nmi(cam):
    return _score(cam, "nmi")


@query(
    _SCORES
    + """, em as (
  select sum(k / n * ln(n * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(n - x - y + k + 1))) as emi
  from (select h.n, ra.k as x, rb.k as y, unnest(range(greatest(1, (ra.k + rb.k - h.n)::bigint), least(ra.k, rb.k)::bigint + 1))::double as k from ra, rb, h))
select round((mi - emi) / ((ha + hb) / 2 - emi), 6) + 0.0::double as score from h, em"""
)
def ami(cam):
    return _score(cam, "ami")


# --- frames --------------------------------------------------------------------------------------------------------

_FDT = 20_000_000
_FRAMES = f""", m as (select min(t) as a, max(t) as b from cam), f as (
  select cam.*, (t - a) // {_FDT} as frame from cam, m where (t - a) // {_FDT} < (b + {_FDT} - a + {_FDT - 1}) // {_FDT} - 1)"""


@query(_FRAMES + " select frame, y, x, count(*) as n from f group by all")
def frames_binary(cam):
    return frames.binary_frames(cam, _FDT)


@query(_FRAMES + " select frame, y, x, arg_max(obj, (t, seq)) as obj from f group by all")
def frames_last_writer(cam):
    return frames.label_frames(cam, _FDT, "obj")


@query(_FRAMES + " select frame, y, x, min(p) as p from f group by all")
def frames_polarity(cam):
    return frames.polarity_frames(cam, _FDT)


def _grey(cam, ids):
    return cam.sparkSession.createDataFrame([(i, (i + 2) / 16, (i + 1) / 16, 0.5) for i in ids], "id long, r double, g double, b double")


def _blend_sql(label: str) -> str:
    """r, g, b of the layers of a pixel (beta, label), ascending labels over black."""
    ink = {"r": f"({label} + 2) / 16.0::double", "g": f"({label} + 1) / 16.0::double", "b": "0.5::double"}
    return ", ".join(
        f"list_reduce(list_prepend({{'v': 0.0::double, 'k': 1.0::double, 'c': 0.0::double}}, list({{'v': 0.0::double, 'k': beta, 'c': {c}}} order by {label})), lambda a, s: {{'v': a.v * s.k + s.c * (1 - s.k), 'k': s.k, 'c': s.c}}).v as {k}"
        for k, c in ink.items()
    )


@query(_FRAMES + f", l as (select frame, y, x, obj, pow(0.7::double, count(*)) as beta from f group by all), k as (select frame, y, x, {_blend_sql('obj')} from l group by frame, y, x) select frame, y, x, round(r, 6) as r, round(g, 6) as g, round(b, 6) as b from k")
def frames_alpha(cam):
    out = frames.alpha_frames(cam.withColumn("obj", F.col("obj").cast("long")), _FDT, "obj", _grey(cam, range(-1, 8)))
    return out.select("frame", "y", "x", *(r6(c).alias(c) for c in "rgb"))


_MIXED = ", ".join(f"round(case when k.state is null then u.{c} else coalesce(u.{c}, 0) * 0.7::double + (case when k.state = {on} then 0.3::double else 0 end) end, 9) + 0.0::double as {c}" for c, on in (("r", 0), ("g", 1), ("b", 9)))


@query(
    _edges_sql(8, 8, 4, 2000, False).rpartition(" select ")[0]
    + f""", st as (select cx, cy, state, m * 1000 + 2000 as index from s where state >= 0),
places as (select t, row_number() over (order by t, seq) - 1 as pos from cam),
ends as (select distinct st.index, places.t from st join places on places.pos = st.index),
layers as (select ends.index, c.y, c.x, c.pol, pow(0.7::double, count(*)) as beta from ends join cam c on c.t > ends.t - 2000000 and c.t <= ends.t group by all),
u as (select index, y, x, {_blend_sql("pol")} from layers group by index, y, x),
k as (select index, cy * 8 + d // 8 as y, cx * 8 + d % 8 as x, state from (select st.*, unnest(range(64)) as d from st))
select coalesce(u.index, k.index)::bigint as index, coalesce(u.y, k.y)::int as y, coalesce(u.x, k.x)::int as x, {_MIXED} from u full join k on k.index = u.index and k.y = u.y and k.x = u.x"""
)
def frames_dual(cam):
    spark = cam.sparkSession
    ends = with_position(cam).select(F.col("pos").alias("index"), "t")
    states = edges.edge_states(cam, 8, 4, 8, 2000).where("state >= 0").join(ends, "index")
    out = frames.dual_frames(cam, states, 2_000_000, 8, _grey(cam, range(4)), spark.createDataFrame([(0, 1.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0)], "id int, r double, g double, b double"))
    return out.select("index", "y", "x", *(r9(c).alias(c) for c in "rgb"))


@query(_FRAMES + " select frame, obj, round(avg(x), 6) as x, round(avg(y), 6) as y, ((count(*) filter (pol = 1) - count(*) filter (pol = 3)) / 10.0)::double as u, ((count(*) filter (pol = 0) - count(*) filter (pol = 2)) / 10.0)::double as v from f where obj <> -1 group by all")
def frame_arrows_votes(cam):
    return frames.vote_arrows(cam, _FDT, "obj").select("frame", "obj", r6("x").alias("x"), r6("y").alias("y"), "u", "v")


@query(
    _GRID + _FRAMES.replace("from cam", "from (select * from cam where obj <> -1) cam")
    + f""", c as (select obj, b, count(*) as n, count(*) filter (pol = 1) - count(*) filter (pol = 3) as u, count(*) filter (pol = 0) - count(*) filter (pol = 2) as v from e group by obj, b),
vel as (select g.obj, g.t, u / n::double as vx, v / n::double as vy from g left join c on c.obj = g.obj and c.b = g.m - 1),
start as (select frame, obj, avg(x) as x, avg(y) as y, frame * {_FDT} + (select min(t) from cam where obj <> -1) as ft from f group by frame, obj),
near as (select s.*, vel.vx, vel.vy, row_number() over (partition by s.frame, s.obj order by abs(vel.t - s.ft), vel.t) as k from start s join vel on vel.obj = s.obj)
select frame, obj::bigint as obj, round(x, 6) as x, round(y, 6) as y, round(vx, 6) as u, round(vy, 6) as v from near where k = 1 and vx is not null"""
)
def frame_arrows_nearest(cam):
    m = _moving(cam)
    return frames.velocity_arrows(m, velocity.votes_velocity(m, _DT, "obj"), "votes", _FDT, "obj").select("frame", "obj", r6("x").alias("x"), r6("y").alias("y"), r6("u").alias("u"), r6("v").alias("v"))


# --- sources -------------------------------------------------------------------------------------------------------


def _roundtrip(suffix: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..sources.files import read_events, write_events

        cam = cam_events(spark, sf_dir).select("seq", "t", "x", "y", "pol")
        # In the shared folder; the single-file formats need it mounted as a file system.
        path = os.path.join(shared_dir(spark).removeprefix("file://"), f"events-{uuid.uuid4().hex}{suffix}")
        write_events(cam.orderBy("seq"), path, width=64)
        return read_events(spark, path, **({"width": 64} if suffix == ".npz" else {})).select("seq", "t", "x", "y", "pol")

    return run


for _s in (".npy", ".npz", ".feather", ".parquet", ".csv"):
    QUERIES[f"io_roundtrip_{_s[1:]}"] = _roundtrip(_s)
    SQL[f"io_roundtrip_{_s[1:]}"] = f"with {CAM_SQL.strip()} select seq, t, x, y, pol from cam"
