"""Benchmark decontamination: greedy string tiling.

Words are lower-cased runs without white space or ASCII punctuation. Seeds are the Karp-Rabin hashes of SEED consecutive
words of the benchmark's items, joined with the documents' own running hashes. For each document and item that share
seeds, runs of seeds on one diagonal are the maximal matches; the longest is marked as a tile, what others overlap is cut
off, and so on until none of SEED words is left. An item leaks into a document when tiles cover at least COVERAGE of its
words, wherever they lie and in whatever order.

The benchmark is a stated query set: it is taken in blocks of about BLOCK words (hashed by item), each broadcast and
held against all documents, so its size is bounded whatever the benchmark's.

Defined results: null or wordless texts match nothing; an item of fewer than SEED words must occur whole; an item without
words never leaks; repeated rows are judged each; a null id is carried as null; an empty table on either side gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, slices, text_rows
from .textvec import PLAIN, buffers, mix, ngrams, pieces, word_hashes

SEED, COVERAGE = 4, 0.5
BLOCK = 2_000_000
_BITS = 22
PAIRS = 1 << 18


def item_words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return word_hashes(np.array([0, len(data)]), data, PLAIN)[0]


class Block:
    """Items of the benchmark with their seeds, sorted by hash."""

    def __init__(self, items: list[tuple[int | None, str | None]], seed: int = SEED):
        self.ids = [i for i, _ in items]
        self.words = [item_words(t or "") for _, t in items]
        self.seed = seed
        # An item shorter than a seed has the hash of its own length as its only seed.
        self.sizes = sorted({min(seed, len(w)) for w in self.words if len(w)}, reverse=True)
        self.by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in self.sizes:
            own = [(n, ngrams(w, k)) for n, w in enumerate(self.words) if len(w) and min(seed, len(w)) == k]
            h = np.concatenate([g for _, g in own])
            item = np.concatenate([np.full(len(g), n) for n, g in own])
            place = np.concatenate([np.arange(len(g)) for _, g in own])
            by = np.argsort(h, kind="stable")
            known = np.zeros(1 << _BITS, bool)
            known[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.by[k] = h[by], item[by], place[by], known

    def matches(self, words: np.ndarray):
        """{item: (k, diagonals, places in the item, seeds)}: the runs of seeds of k words on one diagonal that the item
        and the words share. Pairs of places are only made PAIRS at a time: of a text that says the same over and over,
        runs are far fewer than pairs."""
        found = {}
        for k, (h, item, place, known) in self.by.items():
            g = ngrams(words, k)
            at = np.flatnonzero(known[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
            lo = np.searchsorted(h, g[at])
            n = np.searchsorted(h, g[at], "right") - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            runs, i = [], 0
            total = np.cumsum(n)
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, "right")))
                c = n[i:j]
                e = np.repeat(lo[i:j] - np.concatenate(([0], np.cumsum(c)[:-1])), c) + np.arange(c.sum())
                runs.append(_runs(item[e], np.repeat(at[i:j], c) - place[e], place[e], np.ones(len(e), np.int64)))
                i = j
            if runs:
                own, d, q, length = _runs(*map(np.concatenate, zip(*runs, strict=True))) if len(runs) > 1 else runs[0]
                cut = np.flatnonzero(np.diff(own)) + 1
                for part in np.split(np.arange(len(own)), cut):
                    found[int(own[part[0]])] = k, d[part], q[part], length[part]
        return found


def _runs(item: np.ndarray, d: np.ndarray, q: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs that follow one another on a diagonal of an item, as one."""
    by = np.lexsort((q, d, item))
    item, d, q, length = item[by], d[by], q[by], length[by]
    new = np.ones(len(q), bool)
    new[1:] = (np.diff(item) != 0) | (np.diff(d) != 0) | (q[1:] != q[:-1] + length[:-1])
    first = np.flatnonzero(new)
    return item[first], d[first], q[first], np.add.reduceat(length, first) if len(first) else length


def tiles(p: np.ndarray, t: np.ndarray, k: int, m: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the item, place in the text, words) from pairs of places that share a seed of k words."""
    return tile_runs(*_runs(np.zeros(len(p), np.int64), t - p, p, np.ones(len(p), np.int64))[1:], k, m)


def tile_runs(d: np.ndarray, q: np.ndarray, length: np.ndarray, k: int, m: int) -> list[tuple[int, int, int]]:
    """The longest run that is free becomes a tile, what overlaps one is cut to what is left, until the item (of m words) has
    no k free words in a row."""
    heap = list(zip((-(length + k - 1)).tolist(), q.tolist(), (d + q).tolist(), strict=True))
    heapq.heapify(heap)
    marked_p, marked_t = np.zeros(m, bool), set()
    out = []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = [not marked_p[a + i] and b + i not in marked_t for i in range(n)]
        if all(free):
            marked_p[a : a + n] = True
            marked_t.update(range(b, b + n))
            out.append((a, b, n))
            if "0" * k not in "".join("1" if x else "0" for x in marked_p):
                break
            continue
        i = 0
        while i < n:
            if not free[i]:
                i += 1
                continue
            j = i
            while j < n and free[j]:
                j += 1
            if j - i >= k:
                heapq.heappush(heap, (-(j - i), a + i, b + i))
            i = j
    return out


def leaks_in(column: pa.Array, block: Block, coverage: float = COVERAGE):
    """(row, item number, covered words, tiles, longest tile) of each leak in a column of texts."""
    offsets, raw = buffers(column)
    for i, j in pieces(offsets):
        own = offsets[i : j + 1] - offsets[i]
        words, _, _, first = word_hashes(own, raw[offsets[i] : offsets[j]], PLAIN)
        # One look at the whole piece tells which documents hold a seed at all.
        held = np.zeros(j - i, bool)
        for k, (h, _, _, known) in block.by.items():
            g = ngrams(words, k)
            at = np.flatnonzero(known[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
            at = at[np.isin(g[at], h)]
            row = np.searchsorted(first, at, "right") - 1
            held[row[at + k <= first[row + 1]]] = True
        for r in np.flatnonzero(held).tolist():
            for n, (k, d, q, length) in block.matches(words[first[r] : first[r + 1]]).items():
                m = len(block.words[n])
                reach = np.zeros(m + 1, np.int64)
                np.add.at(reach, q, 1)
                np.add.at(reach, np.minimum(q + length + k - 1, m), -1)
                if (np.cumsum(reach[:m]) > 0).sum() < coverage * m:  # no tiling can cover more than the seeds do
                    continue
                found = tile_runs(d, q, length, k, m)
                covered = sum(x[2] for x in found)
                if covered >= coverage * m:
                    yield i + r, n, covered, len(found), max(x[2] for x in found)


def _blocks(benchmark: DataFrame, words: int = BLOCK):
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.length("text") / 4 + 1)).first()[0] or 0
    n = max(1, math.ceil(size / words))
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield Block([(r["item_id"], r["text"]) for r in own.collect()])


LEAK_SCHEMA = "doc_id long, item_id long, coverage double, n_tiles int, longest int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest) of each pair of a document and an item that leaks into it."""
    spark = docs.sparkSession
    out = None
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def find(batches, shared=shared):
            for batch in slices(batches):
                b = shared.value
                got = list(leaks_in(batch.column("text"), b, coverage))
                rows = pa.array([g[0] for g in got], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), pa.array([b.ids[g[1]] for g in got], pa.int64()), pa.array([g[2] / len(b.words[g[1]]) for g in got], pa.float64()), pa.array([g[3] for g in got], pa.int32()), pa.array([g[4] for g in got], pa.int32())],
                    ["doc_id", "item_id", "coverage", "n_tiles", "longest"],
                )

        part = text_rows(docs).mapInArrow(find, LEAK_SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs, all columns, into which no item leaks."""
    spark = docs.sparkSession
    at = docs.columns.index("text")
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def keep(batches, shared=shared):
            for batch in slices(batches):
                ok = np.ones(batch.num_rows, bool)
                ok[[g[0] for g in leaks_in(batch.column(at).fill_null(""), shared.value, coverage)]] = False
                yield batch.filter(pa.array(ok))

        docs = map_rows(docs, keep)
    return docs
