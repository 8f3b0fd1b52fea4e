"""Packing: concatenate and cut.

Two passes. The first tokenises each partition once, writes the ids with their place inside the partition (a running
sum) to the shared folder, and so fixes the order. Partition totals, one row per partition, are prefix-summed into the
partitions' global offsets. The second pass cuts the concatenation at every multiple of the window; a document that
crosses a cut gets one boundary record (piece) for each window it touches. All windows but the last are full, so the
only padding is the tail of the last window, and none where its fill is a power of two.

Defined results: null text is an empty text, whose only id is the end id; repeated rows are packed once each; a null
doc_id is kept as null; an empty table gives no rows; other columns are ignored. Memory: one Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, staged, text_rows

WINDOW = 1024
END_ID = 0
TOKENIZER = "byte_bpe_50k"
PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _encoder(tokenizer: str):
    """The vocabulary of the tokenizer file as ranks, which encodes to the same ids (see the tests) in a fifth of the
    time, strings of its special tokens included; a tokenizer without ranks falls back to its JSON file."""
    import base64
    import os

    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(f"{tokenizer}.json"))
    if os.path.exists(ranks_file := P.path(f"{tokenizer}.tiktoken")):
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {a.content: i for i, a in t.get_added_tokens_decoder().items()}
        enc = tiktoken.Encoding(tokenizer, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: enc.encode(text, allowed_special="all") if any(x in text for x in special) else enc.encode_ordinary(text)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def tokenised(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids binary of little-endian uint32, n, part, before): before is the running sum inside the partition."""

    def encode(batches):
        enc, part, before = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids = [np.array([*enc(t), end_id], "<u4") for t in batch.column("text").to_pylist()]
            n = np.array([len(x) for x in ids], np.int64)
            at = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(n), pa.array(np.full(len(n), part, np.int64)), pa.array(at)],
                ["doc_id", "ids", "n", "part", "before"],
            )

    return text_rows(docs).mapInArrow(encode, "doc_id long, ids binary, n long, part long, before long")


def pack_documents(docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset and the ids themselves."""
    rows = staged(tokenised(docs, tokenizer, end_id), "pack")
    # One row per partition of the scan: bounded by the number of tasks, hence the single-partition window and broadcast.
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    placed = rows.join(F.broadcast(bases), "part").select("doc_id", "ids", "n", (F.col("base") + F.col("before")).alias("at"))

    def cut(batches):
        for batch in slices(batches):
            n, at = batch.column("n").to_numpy(), batch.column("at").to_numpy()
            if not len(n):
                continue
            first = at // window
            count = (at + n - 1) // window - first + 1
            row = np.repeat(np.arange(len(n)), count)
            seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            lo = np.maximum(at[row], seq * window)
            hi = np.minimum(at[row] + n[row], (seq + 1) * window)
            start, ids = lo - at[row], batch.column("ids")
            own = [memoryview(ids[i].as_buffer()) for i in range(len(n))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(hi - lo), pa.array(n[row]), pa.array(seq), pa.array(lo - seq * window),
                    pa.array([bytes(own[r][4 * s : 4 * (s + k)]) for r, s, k in zip(row.tolist(), start.tolist(), (hi - lo).tolist(), strict=True)], pa.binary()),
                ],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return placed.mapInArrow(cut, PIECE_SCHEMA)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """The packed sequences, sequence_id, n (filled) and ids padded to the window (except where n is a power of two).
    A group is one window, so it is bounded."""
    joined = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    # Zero bytes for the pad id 0; any other id is spelt out as four bytes.
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), (F.lit(window) - F.col("n")).cast("int")))
    body = F.aggregate("p", F.lit("").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    power = (F.col("n") > 0) & (F.col("n").bitwiseAND(F.col("n") - 1) == 0)
    return joined.select("sequence_id", "n", F.when(power, body).otherwise(F.concat(body, pad)).alias("ids"))
