"""Ordered helpers: folds, as-of, nearest and interval joins, count windows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], schema: str, start: Callable[[tuple], Any], step: Callable[[Any, tuple], Iterator[tuple] | list[tuple] | None]) -> DataFrame:
    """Folds the rows of each key in order. step(state, row of `columns`) changes the state and returns output tuples.

    Keys are hashed to partitions, sorted there and streamed through one state, so a group is never gathered; memory is
    a batch and one state, whatever the group's size."""
    need = list(dict.fromkeys([*keys, *columns]))
    at = [need.index(c) for c in columns]
    kind: StructType = _parse_datatype_string(schema)
    names = kind.names

    def run(batches):
        arrow = to_arrow_schema(kind)
        key, state = None, None
        n = len(keys)
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != key:
                    key = row[:n]
                    state = start(key)
                out.extend(step(state, tuple(row[i] for i in at)) or ())
            cols = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    # By a hash of the keys: Spark leaves out a repartition by columns that a join below has dealt by, and AQE, to which the
    # fold asks for nothing, may then read that join's rows as they lie, a key's rows in several tasks.
    placed = df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)
    return placed.select(*need).mapInArrow(run, kind)


def slice_width(df: DataFrame, t: str, least: float = 1, most: float = math.inf) -> int:
    """A length of time by which df is cut into about four slices a shuffle partition, within bounds: groups of (key, slice) are
    then dealt out evenly however few keys there are."""
    lo, hi = df.agg(F.min(t).cast("long"), F.max(t).cast("long")).first()
    parts = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, int(min(max(((hi or 0) - (lo or 0)) / parts, least), most)))


def last_value(df: DataFrame, by: list[str], t: str, order: list[str], value: str, name: str, width: int) -> DataFrame:
    """df with `name`: the last value that is not null up to each row of its key, in the order of (t, *order).

    A key's time is cut into slices. Each slice tells its last value, one row; the last one before each slice is found among
    these and enters the slice, so that slices of one key are worked on by different tasks."""
    own = df.withColumn("__s", F.floor(F.col(t) / width))
    keys, rank = [*by, "__s"], F.struct(t, *order)
    ends = own.groupBy(*keys).agg(F.max_by(value, F.when(F.col(value).isNotNull(), rank)).alias("__end"))
    before = Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    enters = ends.select(*keys, F.last("__end", ignorenulls=True).over(before).alias(value), F.lit(0).alias("__row"))
    # What enters a slice is its first row, so rows are shuffled once and nothing is joined.
    both = own.withColumn("__row", F.lit(1)).unionByName(enters.where(F.col(value).isNotNull()), allowMissingColumns=True)
    here = Window.partitionBy(*keys).orderBy("__row", t, *order)
    return both.withColumn(name, F.last(value, ignorenulls=True).over(here)).where("__row = 1").drop("__s", "__row")


def decayed_sums(df: DataFrame, by: list[str], t: str, order: list[str], dt: float, terms: dict[str, Column], before: dict[str, str] | None = None) -> DataFrame:
    """df with running sums of the terms in which a row counts exp(-age / dt), the row itself with 1; and, by `before`, columns
    with what stood in another column in the row before (null in the first).

    Time is cut into slices of at most 500 dt. A slice's sums at its end are plain aggregates; those of the slices before it
    (beyond 745 dt a double holds nothing of them) enter it, decayed, and within it running sums of exp(age of the slice / dt)
    are scaled back. So a key's slices are worked on by different tasks, without Python."""
    width = slice_width(df, t, 10 * dt, 500 * dt)
    own = df.withColumn("__s", F.floor(F.col(t) / width)).withColumns({f"__w{i}": c.cast("double") for i, c in enumerate(terms.values())})
    keys, since, n = [*by, "__s"], (F.col(t) - F.col("__s") * width) / dt, range(len(terms))
    passed = dict(before or {})
    rank = F.struct(t, *order)
    ends = own.groupBy(*keys).agg(*(F.sum(F.col(f"__w{i}") * F.exp(since - width / dt)).alias(f"__e{i}") for i in n), F.max_by(F.struct(F.lit(1), *passed.values()), rank).alias("__last"))
    reach = math.ceil(745 * dt / width) + 1
    near = Window.partitionBy(*by).orderBy("__s").rangeBetween(-reach, -1)
    prior = Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    decayed = lambda i: F.aggregate("__near", F.lit(0.0), lambda acc, x: acc + x[f"__e{i}"] * F.exp(-(F.col("__s") - 1 - x["__s"]) * (width / dt)))
    enters = ends.withColumn("__near", F.collect_list(F.struct("__s", *(f"__e{i}" for i in n))).over(near)).withColumn("__prior", F.last("__last").over(prior))
    enters = enters.select(*keys, *(decayed(i).alias(f"__x{i}") for i in n), *(F.col("__prior")[old].alias(old) for old in dict.fromkeys(passed.values())), F.lit(0).alias("__row"))
    # What enters a slice is its first row, so rows are shuffled once and nothing is joined.
    grown = own.withColumns({f"__x{i}": F.col(f"__w{i}") * F.exp(since) for i in n} | {"__row": F.lit(1)})
    both = grown.unionByName(enters, allowMissingColumns=True)
    here = Window.partitionBy(*keys).orderBy("__row", t, *order)
    run = here.rowsBetween(Window.unboundedPreceding, 0)
    out = {c: F.exp(-since) * F.sum(f"__x{i}").over(run) for i, c in enumerate(terms)}
    lagged = {c: F.lag(old).over(here) for c, old in passed.items()}
    return both.withColumns(out | lagged).where("__row = 1").drop("__s", "__row", *(f"__{k}{i}" for k in ("w", "x") for i in n))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_t: str, right_t: str, value: str, strict: bool = False, left_seq: str = "seq", right_seq: str = "seq", width: int | None = None) -> DataFrame:
    """left with right's `value` at the last right_t <= left_t (or < if strict), null where there is none; ties of
    right_t by right_seq. One union, cut into slices of time; nothing is joined but what enters a slice."""
    kind = 0 if strict else 1
    a = left.select(F.struct(*left.columns).alias("row"), *by, F.col(left_t).alias("__t"), F.lit(kind).alias("__k"), F.col(left_seq).alias("__q"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    b = right.select(F.lit(None).cast(a.schema["row"].dataType).alias("row"), *by, F.col(right_t).alias("__t"), F.lit(1 - kind).alias("__k"), F.col(right_seq).alias("__q"), F.col(value).alias("__v"))
    seen = last_value(a.unionByName(b), by, "__t", ["__k", "__q"], "__v", "__got", width or slice_width(left, left_t))
    return seen.where("row is not null").select("row.*", F.col("__got").alias(value))


def nearest_join(left: DataFrame, right: DataFrame, by: list[str], left_t: str, right_t: str, values: list[str], width: int | None = None) -> DataFrame:
    """left with the right row whose right_t is nearest; a tie goes to the earlier one, and of one right_t to the least values.

    A key's time is cut into slices, as in last_value. What stands last before a slice is its first row and what stands first
    after it its last one, so slices of one key go to different tasks. Both directions are running values: a frame that ends
    at the end of its partition would be read anew for each row."""
    v = F.struct(F.col(right_t).alias("__rt"), *values)
    a = left.select(F.struct(*left.columns).alias("row"), *by, F.col(left_t).alias("__t"), F.lit(1).alias("__k"), F.lit(None).cast(right.select(v.alias("v")).schema["v"].dataType).alias("v"))
    b = right.select(F.lit(None).cast(a.schema["row"].dataType).alias("row"), *by, F.col(right_t).alias("__t"), F.lit(0).alias("__k"), v.alias("v"))
    both = a.unionByName(b)
    own = both.withColumn("__s", F.floor(F.col("__t") / (width or slice_width(both, "__t"))))
    keys, known = [*by, "__s"], F.col("v").isNotNull()
    ends = own.groupBy(*keys).agg(F.min(F.when(known, F.struct((-F.col("__t")).alias("__n"), "v"))).alias("__last"), F.min("v").alias("__first"))
    slices = lambda order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, F.last("__last.v", True).over(slices(F.asc("__s"))).alias("before"), F.last("__first", True).over(slices(F.desc("__s"))).alias("after"))
    enters = ends.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("__row"), F.col("before").alias("v")), F.struct(F.lit(2).alias("__row"), F.col("after").alias("v")))).alias("e")).select(*keys, "e.*")
    rows = own.withColumn("__row", F.lit(1)).unionByName(enters.where(known), allowMissingColumns=True)
    run = lambda *order: Window.partitionBy(*keys).orderBy(*order, F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumns({"lo": F.last("v", True).over(run("__row", "__t", "__k")), "hi": F.last("v", True).over(run(F.desc("__row"), F.desc("__t"), "__k"))}).where("row is not null")
    best = F.when(F.col("hi").isNull() | (F.col("__t") - F.col("lo.__rt") <= F.col("hi.__rt") - F.col("__t")), F.col("lo")).otherwise(F.col("hi"))
    return seen.withColumn("b", best).select("row.*", F.col("b.__rt").alias(right_t), *(F.col(f"b.{c}").alias(c) for c in values))


def interval_join(points: DataFrame, spans: DataFrame, t: str, low: str, high: str, bucket: int, by: list[str] | None = None, most: int | None = None) -> DataFrame:
    """points with low < t <= high, as an equi-join on time buckets (a span is copied to each bucket it meets).

    With `most`, points of one time are one row of the join and spans of one interval too: what is sorted and compared grows with
    the different times, and pairs are made from the arrays behind it, a point's pairs one after the other. A bucket of more rows
    is dealt by hashes of the times into groups of about `most` points and of as many spans, and each pair of groups is a key of
    its own, so its pairs are made by many tasks; a time of more rows is cut by a hash of the rows, which are to be different."""
    by = by or []
    keys = [*by, "__b"]
    p = points.withColumn("__b", F.floor(F.col(t) / bucket))
    s = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket))))
    met = (F.col(t) > F.col(low)) & (F.col(t) <= F.col(high))
    if most is None:
        return p.join(s, keys).where(met).drop("__b")
    times, ends = [t], [low, high]

    def loads(df, own, name):  # a row a bucket: into how many groups it is dealt, into how many pieces its fullest time is cut
        n = df.groupBy(*keys, *own).agg(F.count("*").alias("n"))
        return n.groupBy(*keys).agg(*(F.ceil(f("n") / most).alias(f"{name}{c}") for f, c in ((F.sum, "groups"), (F.max, "cuts"))))

    def dealt(df, columns, own, name, other):
        cut = F.pmod(F.xxhash64(*columns), F.coalesce(f"{name}cuts", F.lit(1)))
        group = F.pmod(F.xxhash64(*own, cut), F.coalesce(f"{name}groups", F.lit(1))) + 1
        return df.join(full, keys, "left").withColumns({f"{name}": group, f"{other}": F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce(f"{other}groups", F.lit(1))))})

    full = loads(p, times, "__p").join(loads(s, ends, "__s"), keys).where("__pgroups > 1 or __sgroups > 1")
    n, cells = full.agg(F.count("*"), F.sum(F.col("__pgroups") * F.col("__sgroups"))).first()
    cell = keys
    if n:
        full = F.broadcast(full) if n <= 1_000_000 else full
        p, s, cell = dealt(p, points.columns, times, "__p", "__s"), dealt(s, spans.columns, ends, "__s", "__p"), [*keys, "__p", "__s"]
    # By number: AQE would put these few bytes, and with them all their pairs, into a few tasks.
    parts = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), min(cells or 0, 10_000))
    rest = lambda df, own: F.struct(*([c for c in df.columns if c not in by and c not in own] or [F.lit(0).alias("__0")]))
    bundles = lambda df, own, row, name: df.repartition(parts, *cell).groupBy(*cell, *own).agg(F.collect_list(row).alias(name))
    hit = bundles(p, times, rest(points, times), "__prow").join(bundles(s, ends, rest(spans, ends), "__srow"), cell).where(met)
    pairs = hit.withColumn("__prow", F.explode("__prow")).withColumn("__srow", F.explode("__srow"))
    back = lambda df, own, name: [F.col(c) if c in own else F.col(f"{name}.{c}") for c in df.columns if c not in by]
    return pairs.select(*by, *back(points, times, "__prow"), *back(spans, ends, "__srow"))


def n_count_windows(n: int, length: int, hop: int) -> int:
    """Windows end at length + m hop, strictly before n."""
    return max(0, -(-(n - length) // hop))


def count_windows(df: DataFrame, n: int, length: int, hop: int | None = None, pos: str = "pos") -> DataFrame:
    """A copy of each row for each count window [i - length, i) that holds its position; `index` is i."""
    hop = hop or length // 2
    last = n_count_windows(n, length, hop) - 1
    p = F.col(pos)
    lo = F.greatest(F.lit(0), F.floor((p - length) / hop) + 1)
    hi = F.least(F.lit(last), F.floor(p / hop))
    m = F.when(lo <= hi, F.sequence(lo.cast("long"), hi.cast("long")))
    return df.withColumn("__m", F.explode(m)).withColumn("index", F.col("__m") * hop + length).drop("__m")


def frames(df: DataFrame, dt: int, t: str = "t", max_frames: int | None = None) -> DataFrame:
    """Adds `frame`: tumbling [t0 + f dt, ..) from the first t; events at or after the last edge are left out."""
    ends = df.agg(F.min(t).cast("long").alias("a"), F.max(t).cast("long").alias("b")).first()
    if ends["a"] is None:
        return df.withColumn("frame", F.lit(0).cast("long")).limit(0)
    n = -(-(ends["b"] + dt - ends["a"]) // dt) - 1  # edges by arange(t0, t_end + dt, dt), less one
    n = n if max_frames is None else min(n, max_frames)
    f: Column = F.floor((F.col(t) - ends["a"]) / dt).cast("long")
    return df.withColumn("frame", f).where((F.col("frame") >= 0) & (F.col("frame") < n))
