"""Target-distribution importance resampling by hashed n-gram weights and ordered draws.

Words are counted into buckets by the CRC-32 of each run of 1 to `longest` words, in all documents and in the target's
texts. A bucket's gain is 1000 times the log-ratio of its smoothed shares; a document's weight is the mean gain of its
features, and its score adds Gumbel noise from a hash of its id, so that the highest scores are a weighted draw without
replacement.

The draw: each task scores its documents as arrays and writes them in sorted runs of at most RUN rows. The counts of whole
scores (their number is bounded by the formula, not by the data) give the score at which the draw ends; only rows from there
up are shuffled, by ranges of (score, id, run, place), which no key can fill alone. Each range merges its runs' pieces by a
tournament tree whose matches are played block by block, and which is left as soon as it has given what can be drawn.
Counts of the ranges turn places into ranks.

Defined results: a null or empty text has no features, weight 0, and is drawn only if `least` is 0; a null doc_id is hashed as
the empty text and comes first among equal scores; repeated rows are drawn each; an empty target has no counts (T = 0) and an
empty table gives no rows; other columns are ignored. Memory: one Arrow batch, one run, one range.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, staged, text_rows
from .textvec import buffers, pieces

BUCKETS, LONGEST, LEAST, SHARE, SEED = 10_000, 1, 20, 10, "2024"
RUN, RANGE, BLOCK, SMALL = 1 << 17, 1 << 18, 1 << 13, 1 << 8
_NO_ID = -(2**63)  # sorts first; stands for a null doc_id in the runs

_SOLID = np.zeros(256, bool)
_SOLID[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALL = np.uint32(0xFFFFFFFF)
_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, (_TABLE >> 1) ^ np.uint32(0xEDB88320), _TABLE >> 1)
_VECTOR = 24  # bytes of a word taken side by side with other words; what is longer goes to zlib


def _step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _TABLE[(state ^ byte) & 255] ^ (state >> np.uint32(8))


def _extend(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC states after the bytes of one word each."""
    out = np.empty_like(state)
    by = np.argsort(np.minimum(sizes, 255).astype(np.uint8), kind="stable")[::-1]
    now, at, size = state[by], starts[by], np.minimum(sizes[by], 255)
    long = int(np.searchsorted(-size, -_VECTOR, "left"))  # the first words are longer
    for k in range(_VECTOR):
        m = int(np.searchsorted(-size, -k, "left"))
        if m <= long:
            break
        now[long:m] = _step(now[long:m], raw[at[long:m] + k])
    out[by] = now
    for i in by[:long]:
        out[i] = zlib.crc32(raw[starts[i] : starts[i] + sizes[i]].tobytes(), int(state[i] ^ _ALL)) ^ 0xFFFFFFFF
    return out


def features(column: pa.Array, longest: int = LONGEST, buckets: int = BUCKETS):
    """For runs of rows: (first row, features before each row (rows + 1), bucket of each feature)."""
    offsets, raw = buffers(column)
    for i, j in pieces(offsets):
        own, text = offsets[i : j + 1] - offsets[i], _LOWER[raw[offsets[i] : offsets[j]]]
        solid = np.zeros(len(text) + 2, bool)
        solid[1:-1] = _SOLID[text]
        edge = np.zeros(len(text) + 1, bool)
        edge[own] = True
        starts = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
        stops = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
        sizes, row = stops - starts, np.searchsorted(own, starts, "right") - 1
        state, rows, marks = np.full(len(starts), _ALL), [], []
        for n in range(1, longest + 1):
            if n > 1:  # on from the run that is a word shorter, where the row has another word
                whole = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :]) if len(row) >= n else np.zeros(0, np.int64)
                space = np.full(len(whole), 32, np.uint8)
                grown = _extend(_step(state[whole], space), text, starts[whole + n - 1], sizes[whole + n - 1])
                state = np.full(len(starts), _ALL)
                state[whole] = grown
            else:
                state, whole = _extend(state, text, starts, sizes), np.arange(len(starts))
            rows.append(row[whole])
            marks.append((state[whole] ^ _ALL) % np.uint32(buckets))
        rows, marks = np.concatenate(rows), np.concatenate(marks).astype(np.int64)
        if longest > 1:
            by = np.argsort(rows, kind="stable")
            rows, marks = rows[by], marks[by]
        yield i, np.searchsorted(rows, np.arange(j - i + 1)), marks


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket holds. Every task sends at most `buckets` rows."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for _, _, marks in features(batch.column("text"), longest, buckets):
                total += np.bincount(marks, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + k) / ((a + 1) * (t + k)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_ids: list, seed: str = SEED) -> np.ndarray:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of each id."""
    h = np.array([int.from_bytes(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).digest()[:4], "big") for d in doc_ids], np.float64)
    return np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296.0))).astype(np.int64)


_ROW = "doc_id long, n_features long, weight long, score long"
_RUNS = f"{_ROW}, run long, place long"


def scored_runs(docs: DataFrame, worth: np.ndarray, longest: int = LONGEST, seed: str = SEED, run: int = RUN) -> DataFrame:
    """(doc_id, n_features, weight, score, run, place): the rows of a run by falling score, then id."""
    sent = docs.sparkSession.sparkContext.broadcast(worth)

    def score(batches):
        worth, part, nth, held, n = sent.value, TaskContext.get().partitionId(), 0, [], 0

        def out():
            nonlocal nth, held, n
            ids, size, weight, score, null = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.lexsort((size, ids, -score))
            nth, held, n = nth + 1, [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array(ids[by], mask=null[by]), pa.array(size[by]), pa.array(weight[by]), pa.array(score[by]), pa.array(np.full(len(by), part << 32 | nth - 1)), pa.array(np.arange(len(by)))],
                ["doc_id", "n_features", "weight", "score", "run", "place"],
            )

        for batch in slices(batches):
            ids = batch.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            size, total = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for i, first, marks in features(batch.column("text"), longest, len(worth)):
                k = len(first) - 1
                size[i : i + k] = np.diff(first)
                total[i : i + k] = np.diff(np.concatenate(([0], np.cumsum(worth[marks])))[first])
            weight = np.where(size > 0, total // np.maximum(size, 1), 0)
            held.append((ids.fill_null(_NO_ID).to_numpy(), size, weight, weight + noise(ids.to_pylist(), seed), null))
            n += len(ids)
            if n >= run:
                yield out()
        if n:
            yield out()

    return text_rows(docs).mapInArrow(score, _RUNS)


class Run:
    """A sorted run: rows of (-score, doc_id, n_features, run, place, weight), given out in blocks."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.at = rows, 0

    def block(self) -> np.ndarray | None:
        out = self.rows[self.at : self.at + BLOCK]
        self.at += len(out)
        return out if len(out) else None


class Match:
    """A match of the tournament: of two players' blocks, whatever no later block can precede goes on."""

    def __init__(self, *players: Run | Match):
        self.players, self.held, self.over = players, [None, None], [False, False]

    def block(self) -> np.ndarray | None:
        for k in (0, 1):
            if self.held[k] is None and not self.over[k]:
                self.held[k] = self.players[k].block()
                self.over[k] = self.held[k] is None
        a, b = self.held
        if a is None or b is None:
            self.held = [None, None]
            return b if a is None else a
        both = np.concatenate((a, b))
        by = order(both)
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        ends = place[len(a) - 1], place[-1]
        cut = min(ends) + 1
        self.held = [None, None]
        if cut < len(by):
            self.held[int(ends[1] > ends[0])] = both[by[cut:]]
        return both[by[:cut]]


def order(rows: np.ndarray) -> np.ndarray:
    return np.lexsort(rows[:, 4::-1].T)


def tournament(runs: list[np.ndarray]) -> Run | Match:
    """The tree over all runs; those of a few rows start as one."""
    few = [r for r in runs if len(r) < SMALL]
    players: list[Run | Match] = [Run(r) for r in runs if len(r) >= SMALL]
    if few:
        pool = np.concatenate(few)
        players.append(Run(pool[order(pool)]))
    while len(players) > 1:
        players = [Match(*players[k : k + 2]) if k + 1 < len(players) else players[k] for k in range(0, len(players), 2)]
    return players[0]


def _merge(last: int, ties: int):
    """Merges each range. Rows above the score `last` are all drawn and at most `ties` of those at it, so a tree is left
    once it has given so many; the rest goes out unplaced."""

    def merge(batches):
        part, held = TaskContext.get().partitionId(), []
        for batch in batches:
            c = {n: batch.column(n) for n in ("score", "doc_id", "n_features", "run", "place", "weight")}
            rows = np.stack([-c["score"].to_numpy(), c["doc_id"].fill_null(_NO_ID).to_numpy(), *(c[n].to_numpy() for n in ("n_features", "run", "place", "weight"))], 1)
            held.append(rows)
        if not (rows := np.concatenate(held) if held else np.zeros((0, 6), np.int64)).size:
            return
        held.clear()
        rows = rows[np.lexsort((rows[:, 4], rows[:, 3]))]  # each run's piece in its own order
        tree = tournament(np.split(rows, np.flatnonzero(np.diff(rows[:, 3])) + 1))
        wanted, given = int((rows[:, 0] < -last).sum()) + min(ties, int((rows[:, 0] == -last).sum())), 0
        total, seen = len(rows), []
        while given < wanted and (block := tree.block()) is not None:
            block = block[: wanted - given]
            yield _placed(block, part, given + np.arange(len(block)))
            given += len(block)
            seen.append(block[:, 3:5])
        if given < total:
            done = np.concatenate(seen) if seen else np.zeros((0, 2), np.int64)
            pair = np.concatenate((rows[:, 3:5], done))
            _, which, n = np.unique(pair, axis=0, return_index=True, return_counts=True)
            yield _placed(rows[which[n == 1]], part, None)

    return merge


def _placed(rows: np.ndarray, part: int, place: np.ndarray | None) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(rows[:, 1], mask=rows[:, 1] == _NO_ID), pa.array(rows[:, 2]), pa.array(rows[:, 5]), pa.array(-rows[:, 0]), pa.array(np.full(n, part)),
            pa.nulls(n, pa.int64()) if place is None else pa.array(place),
        ],
        ["doc_id", "n_features", "weight", "score", "part", "place"],
    )


def resample(
    docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST, longest: int = LONGEST, buckets: int = BUCKETS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank (null: not drawn). `share` per cent of the documents
    with at least `least` words are drawn."""
    rows, aim = text_rows(docs, id_col, text_col), target.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    worth = gains(bucket_counts(rows, longest, buckets), bucket_counts(aim, longest, buckets))
    runs = staged(scored_runs(rows, worth, longest, seed), "runs")
    # n words make n + (n - 1) + .. features, so the least words are the least features.
    fewest = sum(max(0, least - k) for k in range(longest))
    open_ = F.col("n_features") >= fewest
    # Distinct scores: gains and noise are thousandths of logarithms of 64-bit numbers, so fewer than 200,000.
    tally = sorted(((r["score"], r["n"]) for r in runs.where(open_).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    count = sum(n for _, n in tally) * share // 100
    above, last, size = 0, None, 0
    for value, n in tally:
        size += n
        if above + n >= count:
            last = value
            break
        above += n
    none = F.lit(None).cast("long").alias("rank")
    if not count:
        return runs.select("doc_id", "n_features", "weight", "score", none)
    drawable = open_ & (F.col("score") >= last)
    ranges = runs.where(drawable).repartitionByRange(max(1, -(-size // RANGE)), F.desc("score"), "doc_id", "run", "place")
    merged = staged(ranges.select("doc_id", "n_features", "weight", "score", "run", "place").mapInArrow(_merge(last, count - above), f"{_ROW}, part long, place long"), "ranks")
    # One row per range, at most.
    sizes = merged.groupBy("part").agg(F.count("*").alias("n"))
    bases = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rank = F.col("base") + F.col("place") + 1
    ranked = merged.join(F.broadcast(bases), "part").select("doc_id", "n_features", "weight", "score", F.when(rank <= count, rank).alias("rank"))
    return runs.where(~drawable).select("doc_id", "n_features", "weight", "score", none).unionByName(ranked)


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id is drawn, with their columns."""
    drawn = resample(docs, target, **options).where("rank is not null").select("doc_id").distinct()
    id_ = options.get("id_col", "doc_id")
    return docs.join(drawn.withColumnRenamed("doc_id", "__drawn"), docs[f"`{id_}`"].cast("long").eqNullSafe(F.col("__drawn")), "left_semi")
