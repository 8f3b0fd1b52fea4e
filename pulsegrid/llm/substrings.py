"""Substring dedup: sliding sentence spans.

A sentence ends at ``.``, ``!`` or ``?`` (and closing quotes or brackets) before white space, or at a line break. Every
run of SPAN consecutive sentences of a document is hashed over its words; runs of fewer than WORDS words grow to the
right until they reach it, so that a handful of one-word sentences is no evidence. With `whole` the shortest such runs
that end at each sentence (grown to the left) and single sentences of WORDS words or more are hashed as well: of any
repeated passage of whole sentences that has WORDS words, every sentence then lies in a hashed run inside the passage (one
that the run from the passage's start does not reach ends a run that fits). Equal hashes are joined globally; all but the
first span of a hash (least document, then place) repeat it, and each sentence a repeat covers is removed.

First spans are found by a minimum with map-side combine and joined back on the hash, one row per span: a passage a
third of all documents share costs its rows, never their pairs.

Defined results: null and empty texts have no sentences; a document with fewer than WORDS words (or, unless `whole`, SPAN
sentences) has no span; a span repeated inside one document is removed there too; rows with equal doc_id and text are one document and
share its verdict; a null doc_id sorts last; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged, text_rows
from .textvec import _STEP, buffers, mix, pieces, word_hashes

SPAN, WORDS = 2, 20
BROADCAST_ROWS = 1_000_000
_BYTES = re.compile(rb"[.!?]+(?:[\"')\]]|\xe2\x80\x9d|\xe2\x80\x99)*(?=[ \t-\r])|\n+")

def _byte_ends(raw: bytes) -> np.ndarray:
    """Ends of sentences, in bytes of the text."""
    return np.array([m.end() for m in _BYTES.finditer(raw)], np.int64)


def spans_of(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int = SPAN, least: int = WORDS, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(hash, first sentence, last sentence + 1, words) of each span, and the number of sentences; of one document."""
    if not len(words):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, 0
    # First word of each sentence that has words, and the end.
    cut = np.unique(np.concatenate(([0], np.searchsorted(starts, ends), [len(words)])))
    n = len(cut) - 1
    first = np.arange(max(0, n - span + 1))
    last = np.maximum(first + span, np.searchsorted(cut, cut[first] + least))
    fits = last <= n
    first, last = first[fits], last[fits]
    if whole:
        end = np.arange(1, n + 1)
        begin = np.minimum(end - span, np.searchsorted(cut, cut[end] - least, "right") - 1)
        alone = np.flatnonzero(np.diff(cut) >= least)
        pairs = np.concatenate((first * (n + 1) + last, (begin * (n + 1) + end)[begin >= 0], alone * (n + 2) + 1))
        first, last = np.divmod(np.unique(pairs), n + 1)  # a run found twice is one
    if not len(first):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, n
    up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(words), _STEP[40], np.uint64))), dtype=np.uint64)
    down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(words), pow(int(_STEP[40]), -1, 2**64), np.uint64))), dtype=np.uint64)
    total = np.concatenate(([np.uint64(0)], np.cumsum(words * up[:-1], dtype=np.uint64)))
    a, b = cut[first], cut[last]
    return mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * _STEP[41], 9), first, last, b - a, n


def _analysed(column: pa.Array, span: int, least: int, whole: bool):
    """For each row: (index, words' spans...)."""
    offsets, raw = buffers(column)
    for i, j in pieces(offsets):
        own = offsets[i : j + 1] - offsets[i]
        part = raw[offsets[i] : offsets[j]]
        words, starts, _, first = word_hashes(own, part)
        data = part.tobytes()
        for r in range(j - i):
            a, b = first[r], first[r + 1]
            ends = _byte_ends(data[own[r] : own[r + 1]])
            yield i + r, spans_of(words[a:b], starts[a:b] - own[r], ends, span, least, whole)


def repeated_spans(docs: DataFrame, span: int = SPAN, least: int = WORDS, whole: bool = False) -> DataFrame:
    """(doc_id, rk, removed array<struct<first, last>>, sources array<long>): the sentence numbers that non-first
    repeats cover, and the documents whose spans they repeat; documents without any are left out."""
    rows = text_rows(docs).withColumn("th", F.xxhash64("text")).withColumn("rk", F.xxhash64("doc_id", "th"))

    def hashes(batches):
        for batch in slices(batches):
            row, h, f, last = [], [], [], []
            for r, (hs, a, b, _, _) in _analysed(batch.column("text"), span, least, whole):
                row.append(np.full(len(hs), r, np.int64))
                h.append(hs)
                f.append(a)
                last.append(b)
            join = lambda v, ty: np.concatenate([np.zeros(0, ty), *v])
            at = pa.array(join(row, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("rk").take(at), pa.array(join(h, np.uint64).view(np.int64)), pa.array(join(f, np.int64).astype(np.int32)), pa.array(join(last, np.int64).astype(np.int32))],
                ["doc_id", "rk", "h", "f", "l"],
            )

    spans = staged(rows.select("doc_id", "rk", "text").mapInArrow(hashes, "doc_id long, rk long, h long, f int, l int"), "spans")
    # Which hashes occur more than once is a sum of longs; the first of those only is then looked for.
    # What is joined is written first, so that both sides of the join are plain shuffles, which AQE splits under skew.
    many = staged(spans.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h"), "many")
    again = staged(spans.join(many, "h"), "again")
    place = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("rk").alias("r"), F.col("f").alias("f"))
    first = staged(again.groupBy("h").agg(F.min(place).alias("p")), "first")
    later = again.join(first, "h").where(~(F.col("doc_id").eqNullSafe(F.col("p.d")) & (F.col("rk") == F.col("p.r")) & (F.col("f") == F.col("p.f"))))
    # A document's own spans: bounded by its sentences.
    return later.groupBy("doc_id", "rk").agg(
        F.array_sort(F.collect_set(F.struct(F.col("f").alias("first"), F.col("l").alias("last")))).alias("removed"), F.array_sort(F.collect_set("p.d")).alias("sources")
    )


def remove_repeats(docs: DataFrame, span: int = SPAN, least: int = WORDS, whole: bool = False) -> DataFrame:
    """The documents that lose sentences: doc_id, n_sentences, n_removed, removed (code-point spans "start:end,.."),
    sources (documents that hold the first copies), text (what is left: sentences keep what stood before them)."""
    found = staged(repeated_spans(docs, span, least, whole), "found")
    rows = text_rows(docs).withColumn("rk", F.xxhash64("doc_id", F.xxhash64("text")))
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    keys = found.select("rk")
    # The id stands beside the hash, so that no other document can lose sentences by a collision.
    found = found.withColumnsRenamed({"doc_id": "found_id", "rk": "found_rk"})
    hit = rows.join(F.broadcast(keys) if few else keys, "rk", "left_semi").join(found, (F.col("rk") == F.col("found_rk")) & F.col("doc_id").eqNullSafe(F.col("found_id")))

    def cut(batches):
        for batch in slices(batches):
            n_s, n_r, where, left = [], [], [], []
            for text, removed in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                ends = _byte_ends(data)
                _, starts, stops, _ = word_hashes(np.array([0, len(data)]), np.frombuffer(data, np.uint8))
                c = np.unique(np.concatenate(([0], np.searchsorted(starts, ends), [len(starts)])))
                n = len(c) - 1
                gone = np.zeros(n + 1, np.int64)
                for s in removed:
                    gone[s["first"]] += 1
                    gone[s["last"]] -= 1
                gone = np.cumsum(gone[:n]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                runs = [(int(starts[c[a]]), int(stops[c[b] - 1])) for a, b in edge.reshape(-1, 2).tolist()]
                # Bytes to code points: continuation bytes do not count.
                points = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
                n_s.append(n)
                n_r.append(int(gone.sum()))
                where.append(",".join(f"{points[a]}:{points[b]}" for a, b in runs))
                kept, at = [], 0
                for a, b in runs:
                    kept.append(data[at:a].rstrip(b" \t"))
                    at = b
                kept.append(data[at:])
                left.append(b"".join(kept).decode("utf-8", "surrogatepass").strip() if runs else text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_s, pa.int64()), pa.array(n_r, pa.int64()), pa.array(where, pa.string()), batch.column("sources"), pa.array(left, pa.string())], ["doc_id", "n_sentences", "n_removed", "removed", "sources", "text"])

    return hit.select("doc_id", "text", "removed", "sources").mapInArrow(cut, "doc_id long, n_sentences long, n_removed long, removed string, sources array<long>, text string")

