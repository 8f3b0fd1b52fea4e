"""Online density clustering on a decaying grid with identities that persist, as a batch plan.

Cells decay independently (a fold per cell), frames are sparse tables of the cells that are dense enough at a trigger,
components are found frame by frame in parallel, and frames are linked by an equi-join on cells; identities are chains of these
links. Trigger times are found by blocks; only a few rows a block are chained in one order."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import idiv
from ..model import with_position
from ..plans.staging import discard, staged
from .components import connected_components
from .windows import interval_join, ordered_fold

#: Components of a frame; what sets known ids below all of them; edges of a graph that one task does at once.
_LOCALS, _KNOWN, _SMALL = 1 << 24, 1 << 60, 1 << 18


@dataclass
class Carry:
    """What the events after some trigger need of those before: cells (gx, gy, t, seq, d), at most the lattice; the last trigger's
    number, time and event; its clusters (gx, gy, local, id, first_seen); when the next trigger is due and the next id."""

    cells: DataFrame | None = None
    last: DataFrame | None = None
    frame: int = 0
    at: tuple[int, int] | None = None
    due: int | None = None
    next_id: int = 1


@dataclass(frozen=True)
class DStream:
    grid: int = 5
    tau: float = 5e4
    dense: float = 10.0
    medium: float = 5.0
    interval: int = 5000
    verify: int = 100_000
    min_cells: int = 1
    min_overlap: int = 1
    min_overlap_frac: float = 0.2

    def densities(self, df: DataFrame, run=ordered_fold, before: DataFrame | None = None) -> DataFrame:
        """(seq, t, gx, gy, d): the decayed count of each event's cell just after it. before: a cell's count at an earlier
        event (gx, gy, t, seq, d)."""
        tau = self.tau

        def step(s, row):
            seq, t, gx, gy, known = row
            if known is not None and known == known:  # a stream's rows bring NaN for null
                s[:] = (known, t)
                return []
            s[:] = (s[0] * math.exp(-(t - s[1]) / tau) + 1 if s else 1.0, t)
            return [(seq, t, gx, gy, s[0])]

        cells = df.select("seq", "t", idiv("x", self.grid).cast("int").alias("gx"), idiv("y", self.grid).cast("int").alias("gy"), F.lit(None).cast("double").alias("known"))
        if before is not None:
            cells = cells.unionByName(before.withColumnRenamed("d", "known"))
        return run(cells, ["gx", "gy"], ["t", "seq"], ["seq", "t", "gx", "gy", "known"], "seq long, t long, gx int, gy int, d double", lambda key: [], step)

    def triggers(self, df: DataFrame, block: int = 1_000_000, due: int | None = None, frame: int = 0) -> DataFrame:
        """(frame, t, seq): the events at which clusters are updated, each at least `interval` after the one before (the
        first at `interval`, or at `due`, or later), numbered on from `frame`.

        Events lie in blocks of positions. What a block does to the chain depends on the time from which it is due alone,
        and only on which of the events within one interval of the block's start is hit first: so each block yields, for
        those events and the one after them, when the chain that begins there is next due after the block. These few rows are
        chained in order, which tells when each block is due, and the blocks are replayed in parallel."""
        interval = self.interval
        placed = staged(with_position(df.select("t", "seq")).select("t", "seq", idiv("pos", block).alias("block")), "times")

        def hops(t: np.ndarray) -> np.ndarray:
            """For each event the first one at least an interval later (their number if there is none)."""
            return np.searchsorted(t, t + interval)

        def ends(pdf: pd.DataFrame) -> pd.DataFrame:
            t = np.sort(pdf["t"].to_numpy())
            due = np.append(t + interval, 0)
            to = np.append(hops(t), len(t))
            last = np.where(to < len(t), to, np.arange(len(t) + 1))
            while (last[last] != last).any():
                last = last[last]  # twice as far each time
            near = int(np.searchsorted(t, max(t[0], 0) + interval))  # no block is due later than at this event
            first = np.unique(t[: near + 1], return_index=True)[1]
            return pd.DataFrame({"block": pdf["block"].iloc[0], "t": t[first], "due": due[last[first]]})

        def step(s, row):
            b, t, due = row
            out = []
            if b != s["block"]:
                s |= {"block": b, "hit": False, "from": s["due"]}
                out = [(b, s["due"])]
            if not s["hit"] and t >= s["from"]:
                s |= {"hit": True, "due": due}
            return out

        chain = placed.groupBy("block").applyInPandas(ends, "block long, t long, due long")
        starts = ordered_fold(chain.withColumn("k", F.lit(0)), ["k"], ["block", "t"], ["block", "t", "due"], "block long, due long", lambda key: {"block": None, "hit": False, "due": interval if due is None else due}, step)

        def replay(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["t", "seq"], ignore_index=True)
            t, out = pdf["t"].to_numpy(), []
            to, i = hops(t), int(np.searchsorted(t, pdf["due"].iloc[0]))
            while i < len(t):
                out.append(i)
                i = int(to[i])
            return pdf.loc[out, ["block", "t", "seq"]].assign(nth=np.arange(1, len(out) + 1))

        hit = staged(placed.join(starts, "block").groupBy("block").applyInPandas(replay, "block long, t long, seq long, nth long"), "hits")
        before = hit.groupBy("block").agg(F.count("*").alias("n"))  # one row a block
        before = before.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
        return hit.join(before, "block").select((F.col("before") + F.col("nth") + frame).alias("frame"), "t", "seq")

    def snapshots(self, densities: DataFrame, triggers: DataFrame) -> DataFrame:
        """(frame, t, gx, gy, d): the cells of at least medium density at each trigger."""
        after = Window.partitionBy("gx", "gy").orderBy("t", "seq")
        live = densities.withColumns({"next_t": F.lead("t").over(after), "next_seq": F.lead("seq").over(after)}).where(F.col("d") >= self.medium)
        end = F.col("t") + F.floor(F.lit(self.tau) * F.log(F.col("d") / self.medium) + 1)
        spans = live.select("gx", "gy", "d", F.col("t").alias("at"), F.col("seq").alias("own"), "next_seq", (F.col("t") - 1).alias("lo"), F.least(end, F.coalesce("next_t", end)).cast("long").alias("hi"))
        hit = interval_join(triggers, spans, "t", "lo", "hi", max(1, self.interval))
        hit = hit.where((F.col("own") <= F.col("seq")) & (F.col("next_seq").isNull() | (F.col("next_seq") > F.col("seq"))))
        return hit.withColumn("d", F.col("d") * F.exp(-(F.col("t") - F.col("at")) / self.tau)).where(F.col("d") >= self.medium).select("frame", "t", "gx", "gy", "d")

    def components(self, snapshots: DataFrame) -> DataFrame:
        """(frame, t, gx, gy, local): 8-connected components that hold a dense cell, numbered in raster order. A group is
        the occupied grid of one frame."""
        dense, least = self.dense, self.min_cells

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["gy", "gx"], ignore_index=True)
            x, y = (pdf[c].to_numpy(np.int64) for c in ("gx", "gy"))
            wide = int(x.max() - x.min()) + 3
            key = (y - y.min()) * wide + (x - x.min()) + 1
            root, u, v = np.arange(len(key)), [], []
            for step in (1, wide - 1, wide, wide + 1):  # the cells after each one in raster order
                at = np.minimum(np.searchsorted(key, key + step), len(key) - 1)
                met = np.flatnonzero(key[at] == key + step)
                u.append(met)
                v.append(at[met])
            u, v = np.concatenate(u), np.concatenate(v)
            while len(u):
                ru, rv = root[u], root[v]
                apart = ru != rv
                u, v = u[apart], v[apart]
                np.minimum.at(root, np.maximum(ru, rv)[apart], np.minimum(ru, rv)[apart])
                while not np.array_equal(up := root[root], root):
                    root = up
            first, part, size = np.unique(root, return_inverse=True, return_counts=True)
            most = np.full(len(first), -np.inf)
            np.maximum.at(most, part, pdf["d"].to_numpy())
            good = (size >= least) & (most >= dense)
            local = np.where(good, np.cumsum(good), 0)[part]
            return pdf.assign(local=local)[["frame", "t", "gx", "gy", "local"]][local > 0]

        return snapshots.groupBy("frame").applyInPandas(run, "frame long, t long, gx int, gy int, local long")

    def identities(self, components: DataFrame, carry: Carry | None = None) -> DataFrame:
        """(frame, local, id, first_seen): ids carried from frame to frame by the larger overlap, and from carry's last one.

        A component claims the one before it that it overlaps most, the one with the older id on ties, and of those that claim
        one the largest claim keeps its id. So ids are chains of kept claims, which are found as connected components, named by
        their first component; first components are numbered in the order of (frame, local). Only ties need to know ids: they
        are broken by the chains of the round before until no claim changes, which each round settles at least one frame further."""
        carry = carry or Carry()
        node = lambda frame, local: frame * F.lit(_LOCALS) + local
        area = components.groupBy("frame", "local").agg(F.count("*").alias("area"), F.min("t").alias("t"))
        area = staged(area.withColumn("node", node(F.col("frame"), F.col("local"))), "area")
        before = components.select((F.col("frame") + 1).alias("frame"), "gx", "gy", node(F.col("frame"), F.col("local")).alias("prev"))
        if carry.last is not None:  # known ids come before all nodes of frames
            before = before.unionByName(carry.last.select(F.lit(carry.frame + 1).cast("long").alias("frame"), "gx", "gy", (F.col("id") - _KNOWN).alias("prev")))
        votes = components.join(before, ["frame", "gx", "gy"]).groupBy("frame", "local", "prev").agg(F.count("*").alias("n"))
        votes = staged(votes.join(area, ["frame", "local"]).select("node", "prev", "n", "area"), "votes")
        least, frac = self.min_overlap, self.min_overlap_frac
        roots, seen = None, None
        while True:
            known = votes.withColumn("age", F.col("prev")) if roots is None else votes.join(roots.select(F.col("node").alias("prev"), F.col("root").alias("old")), "prev", "left").withColumn("age", F.coalesce("old", "prev"))
            claims = known.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "age", "prev", "area")).alias("c")).select("node", "c.*").withColumn("n", -F.col("n"))
            claims = claims.where((F.col("n") >= least) | (F.col("n") >= frac * F.col("area")))
            kept = staged(claims.groupBy("prev").agg(F.min(F.struct(-F.col("n"), -F.col("area"), "node")).alias("c")).select("prev", F.col("c.node").alias("node")), "kept")
            roots = connected_components(kept, staged, "prev", "node", discard, _SMALL)
            now = kept.agg(F.count("*"), F.sum(F.xxhash64("prev", "node").cast("decimal(38,0)"))).first()
            if seen == now or (seen is None and votes.groupBy("node").agg(F.max("n").alias("n")).join(votes, ["node", "n"]).groupBy("node").count().where("count > 1").isEmpty()):
                break
            seen = now
        named = area.join(roots, "node", "left").select("frame", "local", "t", F.coalesce("root", "node").alias("root"))
        named = staged(named, "chains")
        births = named.where("root >= 0").groupBy("root").agg(F.min("t").alias("first_seen"))
        births = with_position(births, "root", name="nth").select("root", (F.col("nth") + carry.next_id).alias("id"), "first_seen")
        if carry.last is not None:
            births = births.unionByName(carry.last.select((F.col("id") - _KNOWN).alias("root"), "id", "first_seen").distinct())
        return named.join(births, "root").select("frame", "local", "id", "first_seen")

    def cluster(self, df: DataFrame, label: str = "cluster_id") -> DataFrame:
        """df with the id of each event's cell at the latest trigger up to it, -1 where the cell is too thin, has no
        cluster, or the cluster is too young."""
        return self.advance(df, Carry(), label)[0]

    def advance(self, df: DataFrame, carry: Carry, label: str = "cluster_id") -> tuple[DataFrame, Carry]:
        """(df with its labels, what the events after df need): df are the events that follow those of carry."""
        d = staged(self.densities(df, before=carry.cells), "density")
        trig = staged(self.triggers(df, due=carry.due, frame=carry.frame), "triggers")
        seen = d if carry.cells is None else d.unionByName(carry.cells.select(*d.columns))
        comp = staged(self.components(self.snapshots(seen, trig)), "components")
        cells = staged(comp.join(self.identities(comp, carry), ["frame", "local"]).select("frame", "gx", "gy", "local", "id", "first_seen"), "identities")
        spark, every, known = df.sparkSession, trig, cells
        if carry.at is not None:
            every = every.unionByName(spark.createDataFrame([(carry.frame, *carry.at)], "frame long, t long, seq long"))
        if carry.last is not None:
            known = known.unionByName(carry.last.withColumn("frame", F.lit(carry.frame).cast("long")))
        last = df.agg(F.max("t")).first()[0] or 0
        following = every.select((F.col("frame") - 1).alias("frame"), F.col("t").alias("next_t"), F.col("seq").alias("to_seq"))
        spans = every.join(following, "frame", "left").select("frame", (F.col("t") - 1).alias("lo"), F.greatest("t", F.coalesce("next_t", F.lit(last))).alias("hi"), F.col("seq").alias("from_seq"), "to_seq")
        found = interval_join(d, spans, "t", "lo", "hi", max(1, self.interval))
        # Ties in t go by seq: an event at the time of a trigger belongs to it from that trigger's event on.
        found = found.where((F.col("t") > F.col("lo") + 1) | (F.col("from_seq") <= F.col("seq")))
        found = found.where(F.col("to_seq").isNull() | (F.col("t") < F.col("hi")) | (F.col("to_seq") > F.col("seq"))).join(known, ["frame", "gx", "gy"])
        found = found.where((F.col("d") >= self.medium) & (F.col("t") - F.col("first_seen") >= self.verify)).select("seq", F.col("id").alias(label))
        out = df.join(found, "seq", "left").na.fill(-1, [label])
        newest = seen.groupBy("gx", "gy").agg(F.max(F.struct("t", "seq", "d")).alias("m")).select("gx", "gy", "m.t", "m.seq", "m.d")
        end = trig.agg(F.max(F.struct("frame", "t", "seq"))).first()[0]
        if end is None:
            return out, Carry(newest, carry.last, carry.frame, carry.at, carry.due, carry.next_id)
        top = cells.agg(F.max("id")).first()[0] or 0
        return out, Carry(newest, cells.where(F.col("frame") == end["frame"]).drop("frame"), end["frame"], (end["t"], end["seq"]), end["t"] + self.interval, max(carry.next_id, top + 1))


CLUSTERING = DStream()
FILTER = DStream(verify=20_000, min_cells=3, min_overlap=3)
