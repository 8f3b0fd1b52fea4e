"""Cross-tokenizer alignment: overlap graphs, components, and pair counts over all documents.

A text is encoded by two tokenizers, A over a space and the text, B over the text (it adds the space itself). The tokens of
both are nodes of a bipartite graph, joined where their byte ranges overlap; union-find over its edges gives components, which
are the minimal groups that both tokenizers cut alike. All A-B pairs of a group are links. How many documents hold a pair of
ids linked is counted over the whole corpus, and every document's links are scored by these counts.

In numpy a batch of texts is one graph: the edges are the stretches between successive token ends, and roots are found by
hooking every edge's larger root to its smaller one and pointer jumping, in a number of rounds that grows with the logarithm
of a component's size. Links are never listed one by one: a document keeps its distinct pairs and how often each is linked.

The counts are found without sending documents' pairs about. Documents are dealt into chunks of about CHUNK bytes where they
are read; a chunk adds up its distinct pairs, and only those are shuffled to be counted, and sent back to their chunk. The
chunks' documents then look their pairs up. A pair in every document thus makes one row a chunk.

Defined results: a null or empty text has no tokens, nor has one whose tokens do not spell it (such as one that holds
U+2581): zeros, and an empty groups string; strings of special tokens are plain text; repeated rows are documents each and
count each; a null doc_id is kept; an empty table gives no rows; other columns are ignored. Memory: the distinct pairs of a
chunk's documents (a document longer than CHUNK is a chunk).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged, text_rows

RANKS, PIECES = "byte_bpe_50k", "piece_bpe_32k"
CHUNK, LOT, BLOCK, WIDE = 1 << 24, 1 << 20, 1 << 16, 1 << 12
SHIFT = 15  # an id pair is a << 15 | b
_SPLIT = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, codes binary, times binary, pairs array<int>, ns array<int>"
_DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


class Tokens:
    """A vocabulary by id: the bytes of each token, and its decimal number with the mark that follows it in the string of
    groups, inside and at the end of its side of a group."""

    def __init__(self, spelt: list[bytes], mark: bytes):
        self.spelt = spelt
        self.sizes = np.array([len(x) for x in spelt], np.int64)
        texts = [str(i).encode() + m for i in range(len(spelt)) for m in (b",", mark)]
        self.width = np.array([len(x) for x in texts], np.int64)
        self.written = np.frombuffer(b"".join(x.ljust(6) for x in texts), np.uint8).reshape(-1, 6)


@lru_cache(maxsize=2)
def tokenizers(ranks: str = RANKS, pieces: str = PIECES):
    """(encode A, its tokens, encode B, its tokens)."""
    import public_tokenizers as P
    import sentencepiece
    import tiktoken

    with open(P.path(f"{ranks}.tiktoken"), "rb") as f:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding(ranks, pat_str=P.PATTERN, mergeable_ranks=known, special_tokens={})
    spelt = [b""] * (max(known.values()) + 1)
    for token, i in known.items():
        spelt[i] = token
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path(f"{pieces}.model"))
    own = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in range(sp.get_piece_size()) for p in [sp.id_to_piece(i)]]
    if len(own) > 1 << SHIFT or len(spelt) > 1 << 31 - SHIFT:
        raise ValueError("the vocabularies are too large for pairs of 31 bits")
    return (lambda text: enc.encode_ordinary(" " + text)), Tokens(spelt, b"|"), (lambda text: sp.encode(text, num_threads=1)), Tokens(own, b";")


def components(n_a: int, n_b: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The root (least node) of every node of the graph with edges a[k] - n_a + b[k]; the B tokens' nodes follow the A's."""
    root = np.arange(n_a + n_b)
    u, v = a, n_a + b
    while True:
        ru, rv = root[u], root[v]
        apart = ru != rv
        if not apart.any():
            return root
        u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while not np.array_equal(up := root[root], root):
            root = up


class Aligned:
    """Texts of one batch: what tokens they have, in which groups."""

    def __init__(self, texts: list[str], ranks: str = RANKS, pieces: str = PIECES):
        encode_a, self.va, encode_b, self.vb = tokenizers(ranks, pieces)
        ids_a, ids_b = [], []
        for text in texts:
            x, y = (encode_a(text), encode_b(text)) if text else ([], [])
            if text:
                whole = b" " + text.encode()
                # A is a byte-level vocabulary, which spells whatever it reads.
                if b"".join(map(self.vb.spelt.__getitem__, y)) != whole or int(self.va.sizes[x].sum()) != len(whole):
                    x, y = [], []
            ids_a.append(np.array(x, np.int64))
            ids_b.append(np.array(y, np.int64))
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        none = [np.zeros(0, np.int64)]
        self.a, self.b = np.concatenate(ids_a or none), np.concatenate(ids_b or none)
        ends_a, ends_b = np.cumsum(self.va.sizes[self.a]), np.cumsum(self.vb.sizes[self.b])
        cut = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 0, bool)
        cut[ends_a] = cut[ends_b] = True
        ends = np.flatnonzero(cut)
        root = components(len(self.a), len(self.b), np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends))
        own = root[: len(self.a)]
        self.group_a = np.cumsum(np.diff(own, prepend=own[:1]) != 0)
        self.group_b = self.group_a[root[len(self.a) :]]
        self.groups = int(self.group_a[-1]) + 1 if len(own) else 0
        self.size_a, self.size_b = np.bincount(self.group_a, minlength=self.groups), np.bincount(self.group_b, minlength=self.groups)
        self.before_a, self.before_b = np.cumsum(self.size_a) - self.size_a, np.cumsum(self.size_b) - self.size_b
        docs = np.repeat(np.arange(len(texts)), self.n_a)
        self.doc = docs[self.before_a]  # of each group
        self.n_groups = np.bincount(self.doc, minlength=len(texts))
        self.n_links = np.zeros(len(texts), np.int64)
        np.add.at(self.n_links, self.doc, self.size_a * self.size_b)

    def strings(self) -> Iterator[bytes]:
        """`a1,a2|b1;a3|b2,b3` of each text."""
        n_a, n = len(self.a), len(self.a) + len(self.b)
        code = np.empty(n, np.int64)
        last_a, last_b = np.zeros(n_a, bool), np.zeros(len(self.b), bool)
        last_a[self.before_a + self.size_a - 1] = True
        last_b[self.before_b + self.size_b - 1] = True
        code[np.arange(n_a) + self.before_b[self.group_a]] = 2 * self.a + last_a
        code[np.arange(len(self.b)) + (self.before_a + self.size_a)[self.group_b]] = 2 * (len(self.va.spelt) + self.b) + last_b
        written = np.concatenate((self.va.written, self.vb.written))
        width = np.concatenate((self.va.width, self.vb.width))[code]
        raw = written[code][np.arange(6) < width[:, None]]
        ends = np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))]
        for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield raw[i : j - 1].tobytes() if j > i else b""

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first pair of each text (texts + 1 entries), pair codes sorted within a text, how often each is linked)."""
        n = self.size_a * self.size_b
        few = np.flatnonzero(n <= WIDE)
        m = n[few]
        at = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        g = np.repeat(few, m)
        i, j = np.divmod(at, self.size_b[g])
        keys = self.doc[g] << 31 | self.a[self.before_a[g] + i] << SHIFT | self.b[self.before_b[g] + j]
        keys, times = np.unique(keys, return_counts=True)
        wide = [(keys, times)]
        for g in np.flatnonzero(n > WIDE):  # a long group: its distinct ids alone are paired
            (x, k), (y, l) = (np.unique(ids[o[g] : o[g] + s[g]], return_counts=True) for ids, o, s in ((self.a, self.before_a, self.size_a), (self.b, self.before_b, self.size_b)))
            wide.append(((int(self.doc[g]) << 31 | x[:, None] << SHIFT | y).ravel(), np.outer(k, l).ravel()))
        if len(wide) > 1:
            keys, times = added(wide)
        return np.searchsorted(keys, np.arange(len(self.n_a) + 1) << 31), (keys & (1 << 31) - 1).astype(np.int32), times


def added(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of each one's numbers."""
    keys, n = (np.concatenate(x) for x in zip(*tables, strict=True))
    by = np.argsort(keys, kind="stable")
    keys, n = keys[by], n[by]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1) != 0) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _lots(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about LOT bytes of text."""
    size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + LOT, "right")))
        yield batch.slice(i, j - i)
        i = j


def _ints(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int32()))


def split(docs: DataFrame, ranks: str = RANKS, pieces: str = PIECES, spell: bool = False) -> DataFrame:
    """Rows of two kinds: documents with their pairs (pairs null), and blocks of a chunk's pairs with how many of its
    documents hold each. groups is the string itself with `spell`, else its SHA-256."""
    schema = pa.schema([("chunk", pa.int64()), *((n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()), ("codes", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int32())), ("ns", pa.list_(pa.int32()))])

    def chunk_rows(chunk, held):
        if held:
            keys, n = added(held)
            for k in range(0, len(keys), BLOCK):
                own, size = keys[k : k + BLOCK], n[k : k + BLOCK]
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), none, none, none, none, none, pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), _ints(own), _ints(size)], schema=schema)

    def work(batches):
        part, nth, size, held = TaskContext.get().partitionId(), 0, 0, []
        for whole in slices(batches):
            for batch in _lots(whole):
                texts = batch.column("text").to_pylist()
                x = Aligned(texts, ranks, pieces)
                first, codes, times = x.pairs()
                spelt = [s.decode() if spell else hashlib.sha256(s).hexdigest() if s else "" for s in x.strings()]
                cut = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
                chunk = part << 31 | nth
                empty = pa.nulls(len(texts), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(texts), chunk)), batch.column("doc_id"), pa.array(x.n_a), pa.array(x.n_b), pa.array(x.n_groups), pa.array(x.n_links), pa.array(spelt, pa.string()),
                        pa.array([codes[i:j].tobytes() for i, j in cut], pa.binary()), pa.array([times[i:j].astype("<i8").tobytes() for i, j in cut], pa.binary()), empty, empty,
                    ],
                    schema=schema,
                )
                held.append(tuple(v.astype(np.int32) for v in np.unique(codes, return_counts=True)))
                size += batch.column("text").nbytes
                if size >= CHUNK:
                    yield from chunk_rows(chunk, held)
                    nth, size, held = nth + 1, 0, []
        yield from chunk_rows(part << 31 | nth, held)

    return text_rows(docs).mapInArrow(work, _SPLIT)


def _chunk_pairs(parts: DataFrame) -> DataFrame:
    return parts.where("pairs is not null").select("chunk", F.explode(F.arrays_zip("pairs", "ns")).alias("p")).select("chunk", F.col("p.pairs").alias("code"), F.col("p.ns").cast("long").alias("n"))


def _counts(parts: DataFrame) -> DataFrame:
    return _chunk_pairs(parts).groupBy("code").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, ranks: str = RANKS, pieces: str = PIECES) -> DataFrame:
    """(a_id, b_id, n_docs): in how many documents the two ids are linked."""
    parts = staged(split(docs, ranks, pieces), "aligned")
    return _counts(parts).select(F.shiftright("code", SHIFT).alias("a_id"), F.col("code").bitwiseAND((1 << SHIFT) - 1).alias("b_id"), F.col("n").alias("n_docs"))


def _score(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """A chunk's documents with the counts of their pairs (twice the count, and one more if it is its A id's highest)."""
    docs = docs.combine_chunks()
    code, worth = (pairs.column(n).to_numpy() for n in ("code", "worth"))
    by = np.argsort(code)
    code, worth = code[by], worth[by]
    best, total = [], []
    for codes, times in zip(docs.column("codes"), docs.column("times"), strict=True):
        own, n = np.frombuffer(codes.as_buffer(), "<i4"), np.frombuffer(times.as_buffer(), "<i8")
        w = worth[np.searchsorted(code, own)] if len(own) else np.zeros(0, np.int64)
        best.append(int((n * (w & 1)).sum()))
        total.append(int((n * (w >> 1)).sum()))
    kept = [docs.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.Table.from_arrays([*kept, pa.array(best, pa.int64()), pa.array(total, pa.int64()), docs.column("groups")], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])


def align_documents(docs: DataFrame, ranks: str = RANKS, pieces: str = PIECES, spell: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair count is the highest of their A id), count_sum (pair
    counts added up over the links), groups."""
    parts = staged(split(docs, ranks, pieces, spell), "aligned")
    counts = staged(_counts(parts), "pairs")
    a = F.shiftright("code", SHIFT)
    # One row for each A id: bounded by the vocabulary.
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("high"))
    worth = counts.join(F.broadcast(highest), a == F.col("a")).select("code", (2 * F.col("n") + (F.col("n") == F.col("high")).cast("long")).alias("worth"))
    back = _chunk_pairs(parts).select("chunk", "code").join(worth, "code").select(F.col("chunk").alias("lot"), "code", "worth")
    rows = parts.where("pairs is null").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "codes", "times")
    return rows.groupBy("chunk").cogroup(back.groupBy("lot")).applyInArrow(_score, _DIGEST)
