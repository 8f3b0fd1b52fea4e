"""Toxicity: class-conditional Kneser-Ney models over code points and words.

Texts are lower-cased; every code point is a symbol of its own, white space one blank, so the vocabulary is open. The toxic
and the ordinary model share their backoff: at order 5 each class has its own discounted counts and at orders 4 and 3 its
own continuation counts, each with its own backoff weight. Below lies one distribution for both, of Kneser-Ney continuation
counts gathered from ALL documents, labelled or not: order 3 with weight WEIGHT, else order 2, which backs off to order 1.
A rare expression is thus smoothed alike in both classes and only differs by what its class has seen. Higher shared orders
and more weight on order 3 were tried and are worse: a context that only toxic texts hold then predicts its next symbol as
well for the ordinary class, and a toxic word says nothing but at its beginning (README).

Words have models of their own, which tell toxic words made of ordinary syllables: each class's discounted counts back off
to the share of a word in all documents (how many documents hold it). A document's evidence is the log-likelihood ratio of
toxic to ordinary, by symbol and by word, over the whole text (normalised by its length) and where it is strongest, turned
into a score by a logistic function.

What is gathered from the corpus are its distinct 4-grams and its words, in distributed tables that grow with it; the counts
that the labelled n-grams and words back off to are joined out of them. An n-gram that neither class has seen has the same probability in
both, so the ratios need entries for the labelled n-grams alone. The classes' counts are fitted on a bounded sample: at
most LABELLED label rows of folds 1 to 4 (fold 0 is held out) with at most LABELLED_CHARS code points in all (whole texts,
in the order of a hash). That bounds what reaches the driver and is broadcast: tables of at most twice LABELLED_CHARS entries by order.
The logistic function is fitted on the same rows, each measured by counts that leave its own fold out.

Defined results: null and empty texts are scored (no evidence, so the score of the intercept); several label rows of a
document count as toxic if one does; null labels are ignored; without labels of both classes every score is the share of
toxic labels (0 without labels); repeated rows are scored each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_rows, slices, staged, text_rows
from .textvec import PLAIN, word_hashes

ORDER, SHARED = 5, 2
WEIGHT = 0.1
POINT = 21  # bits of a code point
DISCOUNT = 0.75
WINDOW, STRIDE, GAP, WORDS = 128, 16, 5, 8
LABELLED, LABELLED_CHARS = 20_000, 1 << 24
CHUNK = 1 << 18
PENDING = 1 << 21
_RNG = np.random.Generator(np.random.PCG64(20240301))
_POINTS = _RNG.integers(1, 2**63, 0x10000, dtype=np.uint64)
_PLACES = _RNG.integers(1, 2**63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANKS = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, bounds of the texts): each text is followed by GAP blanks, and GAP blanks come first."""
    low = [t.lower() for t in texts]
    raw = np.frombuffer((" " * GAP + "".join(t + " " * GAP for t in low)).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    raw[np.isin(raw, _BLANKS)] = 32
    return raw, np.cumsum([0, *(len(t) + GAP for t in low)])


def point_hashes(s: np.ndarray) -> np.ndarray:
    return np.where(s < 0x10000, _POINTS[np.minimum(s, 0xFFFF)], s.astype(np.uint64) * _PLACES[0])


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the lower-cased words, for each text the place of its first one; one more at the end)."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    h, _, _, first = word_hashes(np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8), PLAIN)
    return h, first


def gram_hashes(s: np.ndarray) -> list[np.ndarray]:
    """For k = 1 .. ORDER: the hash of the k symbols up to each place, from place ORDER - 1 on."""
    t = point_hashes(s)
    n = len(s) - ORDER + 1
    out, h = [], np.zeros(n, np.uint64)
    for k in range(ORDER):
        h = h + t[ORDER - 1 - k : ORDER - 1 - k + n] * _PLACES[k]
        out.append(h)
    return out


def packed(*columns: np.ndarray) -> np.ndarray:
    """Symbols, the first one in front, as one number."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        out = out << POINT | c.astype(np.int64)
    return out


def groups(texts: list[str]):
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n < CHUNK):
            n += len(texts[j])
            j += 1
        yield i, j
        i = j


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)), F.lit(0)).cast("int")


def label_rows(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic 0/1, fold), one row a document."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    return rows.groupBy("doc_id").agg(F.max(F.least(F.lit(1), F.greatest(F.lit(0), "toxic"))).alias("toxic")).withColumn("fold", fold(F.col("doc_id")))


FOLDS = (1, 2, 3, 4)
COUNTS = [f"{c}{k}" for k in FOLDS for c in ("t", "o")]


def corpus_grams(docs: DataFrame) -> DataFrame:
    """(a, x): the distinct 4-grams of all documents, x the first symbol and a the other three."""

    def distinct(batches):
        held = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        fresh: list = []  # at most PENDING or one group of texts over it

        def settle():
            h, *rest = (np.concatenate(c) for c in zip(held, *fresh, strict=True))
            _, i = np.unique(h, return_index=True)
            return h[i], *(c[i] for c in rest)

        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            for i, j in groups(texts):
                s, _ = symbols(texts[i:j])
                h, at = np.unique(gram_hashes(s)[3], return_index=True)
                at += ORDER - 1
                fresh.append((h, packed(s[at - 2], s[at - 1], s[at]), s[at - 3].astype(np.int32)))
                if sum(len(f[0]) for f in fresh) > PENDING:
                    held, fresh = settle(), []
        if fresh:
            held = settle()
        for i in range(0, len(held[0]), PENDING):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + PENDING]) for c in held[1:]], ["a", "x"])

    return text_rows(docs).where("text <> ''").mapInArrow(distinct, "a long, x int").distinct()


def labelled_grams(texts: DataFrame) -> DataFrame:
    """(b, a, t1, o1, .. t4, o4): the ORDER-grams of the texts (their last three symbols, a, and those before, b) and how often the
    toxic and ordinary ones of each fold hold them."""

    def count(batches):
        for batch in slices(batches):
            rows, ys = batch.column("text").to_pylist(), 2 * (batch.column("fold").to_numpy() - 1) + 1 - batch.column("toxic").to_numpy()
            for y in np.unique(ys).tolist():
                own = [rows[i] for i in np.flatnonzero(ys == y).tolist()]
                for i, j in groups(own):
                    s, _ = symbols(own[i:j])
                    _, at, n = np.unique(gram_hashes(s)[ORDER - 1][1:], return_index=True, return_counts=True)
                    at += ORDER
                    yield pa.RecordBatch.from_arrays([pa.array(packed(*(s[at - k] for k in range(ORDER - 1, 2, -1)))), pa.array(packed(s[at - 2], s[at - 1], s[at])), pa.array(np.full(len(at), y, np.int32)), pa.array(n.astype(np.int64))], ["b", "a", "y", "n"])

    counts = texts.mapInArrow(count, "b long, a long, y int, n long")
    return counts.groupBy("b", "a").agg(*(F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).cast("int").alias(c) for y, c in enumerate(COUNTS)))


def corpus_words(docs: DataFrame) -> DataFrame:
    """(w, c): the words of all documents and how many documents hold each."""

    def count(batches):
        held, fresh = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), []

        def settle():
            h, n = (np.concatenate(c) for c in zip(held, *fresh, strict=True))
            h, at = np.unique(h, return_inverse=True)
            return h, np.bincount(at, n, len(h)).astype(np.int64)

        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            for i, j in groups(texts):
                h, first = words(texts[i:j])
                row = np.repeat(np.arange(j - i), np.diff(first))
                by = np.lexsort((row, h))
                h, row = h[by], row[by]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                fresh.append(np.unique(h[new], return_counts=True))
                if sum(len(f[0]) for f in fresh) > PENDING:
                    held, fresh = settle(), []
        if fresh:
            held = settle()
        for i in range(0, len(held[0]), PENDING):
            yield pa.RecordBatch.from_arrays([pa.array(held[0][i : i + PENDING].view(np.int64)), pa.array(held[1][i : i + PENDING])], ["w", "c"])

    return text_rows(docs).where("text <> ''").mapInArrow(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def labelled_words(texts: DataFrame) -> DataFrame:
    """(w, t1, o1, .. t4, o4): the words of the texts and how often the toxic and ordinary ones of each fold hold them."""

    def count(batches):
        for batch in slices(batches):
            rows, ys = batch.column("text").to_pylist(), 2 * (batch.column("fold").to_numpy() - 1) + 1 - batch.column("toxic").to_numpy()
            for y in np.unique(ys).tolist():
                h, n = np.unique(words([rows[i] for i in np.flatnonzero(ys == y).tolist()])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), y, np.int32)), pa.array(n.astype(np.int64))], ["w", "y", "n"])

    counts = texts.mapInArrow(count, "w long, y int, n long")
    return counts.groupBy("w").agg(*(F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).cast("int").alias(c) for y, c in enumerate(COUNTS)))


def word_ratios(keys: np.ndarray, shared: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> tuple[Lookup, float]:
    """log p(word | toxic) - log p(word | ordinary) of each word, and of one that neither class has seen. Both classes back
    off to the share of a word in all documents' words (each document's distinct ones)."""
    logs, backs = [], []
    for n in (toxic.astype(float), ordinary.astype(float)):
        total, kinds = np.full(len(n), n.sum()), np.full(len(n), (n > 0).sum())
        logs.append(np.log(interpolated(n, total, kinds, shared)))
        backs.append(float(np.log(DISCOUNT * (n > 0).sum() / n.sum())) if n.sum() else 0.0)
    return Lookup(keys, logs[0] - logs[1]), backs[0] - backs[1]


def shared_counts(grams: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted trigram (a) the continuation counts that orders 3, 2 and 1 need: c3, its context's total3 and kinds3,
    and so on to c1. A count is the number of distinct symbols in front, in all documents."""
    last = lambda n: F.col("a").bitwiseAND(F.lit((1 << n * POINT) - 1))
    counts = {3: staged(grams.groupBy("a").agg(F.count("*").alias("c")), "c3")}
    for k in (2, 1):
        counts[k] = staged(counts[k + 1].groupBy(last(k).alias("a")).agg(F.count("*").alias("c")), f"c{k}")
    rows = wanted
    for k in (3, 2):
        contexts = counts[k].groupBy(F.shiftright("a", POINT).alias("h")).agg(F.sum("c").alias(f"total{k}"), F.count("*").alias(f"kinds{k}"))
        rows = rows.withColumns({"k": last(k), "h": F.shiftright(last(k), POINT)}).join(counts[k].select(F.col("a").alias("k"), F.col("c").alias(f"c{k}")), "k").join(contexts, "h").drop("h", "k")
    whole = counts[1].agg(F.sum("c").alias("t"), F.count("*").alias("k")).first()  # at most all code points
    rows = rows.withColumn("k", last(1)).join(counts[1].select(F.col("a").alias("k"), F.col("c").alias("c1")), "k").drop("k")
    out = staged(rows.withColumns({"total1": F.lit(whole["t"] or 0), "kinds1": F.lit(whole["k"])}), "shared")
    discard(*counts.values())
    return out


def interpolated(n: np.ndarray, total: np.ndarray, kinds: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Absolute discounting: a context that was never seen leaves all to the order below."""
    seen = np.maximum(total, 1)
    return np.maximum(n - DISCOUNT, 0) / seen + np.where(total > 0, DISCOUNT * kinds / seen, 1.0) * below


class Grams:
    """The labelled n-grams of orders ORDER to SHARED + 1 with what they back off to. `keys[k]` are the distinct hashes of
    k symbols, as grams and as contexts; for each gram of `own[k]`: `gram[k]` and `context[k]` are its place and that of
    its context in keys, `suffix[k]` the place in own[k - 1] of what it backs off to."""

    def __init__(self, b: np.ndarray, a: np.ndarray, shared: pa.Table):
        point = (1 << POINT) - 1
        s = [(x >> POINT * k & point).astype(np.uint32) for x, n in ((b, ORDER - 3), (a, 3)) for k in range(n - 1, -1, -1)]
        t = [point_hashes(x) for x in s]
        hashes = lambda last, k: sum((t[last - j] * _PLACES[j] for j in range(k)), np.zeros(len(b), np.uint64))
        ends = {k: hashes(ORDER - 1, k) for k in range(SHARED + 1, ORDER + 1)}
        contexts = {k: hashes(ORDER - 2, k) for k in range(SHARED, ORDER)}
        self.keys, self.gram, self.context, self.suffix = {}, {}, {}, {}
        every = {}
        for k in range(SHARED, ORDER + 1):
            parts = [x for x in (ends.get(k), contexts.get(k)) if x is not None]
            self.keys[k], at = np.unique(np.concatenate(parts), return_inverse=True)
            every[k] = at[: len(b)], at[-len(b) :] if len(b) else at
        below = None
        self.order = np.unique(every[ORDER][0], return_index=True)[1]  # own[ORDER] is in the order of its keys
        for k in range(ORDER, SHARED, -1):
            _, first, own = np.unique(every[k][0], return_index=True, return_inverse=True)  # of each gram once
            self.gram[k], self.context[k] = every[k][0][first], every[k - 1][1][first]
            if below is not None:
                self.suffix[k + 1] = own[below]
            below = first
        key = shared["a"].to_numpy()
        by = np.argsort(key)
        self.below = _shared(shared)[by[np.searchsorted(key, a[below], sorter=by)]] if len(a) else np.zeros(0)

    def probabilities(self, n: np.ndarray) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
        """From a class's counts of the grams of the highest order: p of each gram's last symbol, by order, and the
        backoff weights of its contexts. Orders below count in how many different ways a gram is continued to the left."""
        counts = {ORDER: n[self.order]}
        for k in range(ORDER, SHARED + 1, -1):
            counts[k - 1] = np.bincount(self.suffix[k], counts[k] > 0, len(self.gram[k - 1]))
        p, back, lower = {}, {}, self.below
        for k in range(SHARED + 1, ORDER + 1):
            size, context = len(self.keys[k - 1]), self.context[k]
            total, kinds = np.bincount(context, counts[k], size), np.bincount(context, counts[k] > 0, size)
            if k > SHARED + 1:
                lower = p[k - 1][self.suffix[k]]
            p[k] = interpolated(counts[k], total[context], kinds[context], lower)
            back[k - 1] = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        return p, back

    def tables(self, toxic: np.ndarray, ordinary: np.ndarray) -> dict[int, Lookup]:
        (p, back_p), (q, back_q) = self.probabilities(toxic.astype(float)), self.probabilities(ordinary.astype(float))
        out = {}
        for k in self.keys:
            ratio, back = np.full(len(self.keys[k]), np.nan), np.zeros(len(self.keys[k]))
            if k > SHARED:
                ratio[self.gram[k]] = np.log(p[k]) - np.log(q[k])
            if k < ORDER:
                back = np.log(back_p[k]) - np.log(back_q[k])
            out[k] = Lookup(self.keys[k], ratio, back)
        return out


def _shared(counts: pa.Table) -> np.ndarray:
    """p(last symbol | those before) of each row's trigram, of all documents: order 3 with weight WEIGHT, else order 2."""
    own = {k: counts[k].to_numpy().astype(float) for k in counts.column_names if k != "a"}
    p = [1.0 / np.maximum(own["kinds1"], 1)]
    for k in (1, 2, 3):
        p.append(interpolated(own[f"c{k}"], own[f"total{k}"], own[f"kinds{k}"], p[-1]))
    return WEIGHT * p[3] + (1 - WEIGHT) * p[2]


class Lookup:
    """Values by 64-bit key: open addressing, at most half full."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.probes = np.zeros(size, np.uint64), 0
        self.values = [np.zeros(size, np.float32) for _ in values]
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            self.probes += 1
            free = todo[self.keys[slot[todo]] == 0]
            got, i = np.unique(slot[free], return_index=True)
            self.keys[got] = keys[free[i]]
            for v, own in zip(self.values, values, strict=True):
                v[got] = own[free[i]]
            left = np.ones(len(keys), bool)
            left[free[i]] = False
            todo = todo[left[todo]]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the slots of the keys, whether they are there)."""
        slot = self._slot(q)
        held = self.keys[slot]
        ok = held == q
        todo = np.flatnonzero(~ok & (held != 0))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[todo]]
            ok[todo[held == q[todo]]] = True
            todo = todo[(held != q[todo]) & (held != 0)]
        return slot, ok


class Tables:
    """By order: the log-likelihood ratio of each gram (none where it is a context alone) and of its backoff weight; and the
    ratios of words."""

    def __init__(self, by: dict[int, Lookup], words: tuple[Lookup, float]):
        self.by, self.words = by, words

    def word_ratios(self, h: np.ndarray) -> np.ndarray:
        table, unseen = self.words
        slot, ok = table(h)
        return np.where(ok, table.values[0][slot], unseen).astype(float)

    def ratios(self, s: np.ndarray) -> np.ndarray:
        """log p(symbol | those before, toxic) - log p(.. ordinary) at each place from ORDER - 1 on. What no class has
        seen backs off, down to what is shared, which is the same in both. The first place has no context."""
        g = gram_hashes(s)
        out = np.zeros(len(g[0]))
        at = np.arange(1, len(out))
        for k in range(ORDER, SHARED, -1):
            slot, ok = self.by[k](g[k - 1][at])
            ratio = np.where(ok, self.by[k].values[0][slot], np.nan)
            here = ~np.isnan(ratio)
            out[at[here]] += ratio[here]
            at = at[~here]
            slot, ok = self.by[k - 1](g[k - 2][at - 1])
            out[at] += np.where(ok, self.by[k - 1].values[1][slot], 0)
        return out


FEATURES = 6


def evidence(texts: list[str], tables: Tables) -> np.ndarray:
    """Per text: mean log-likelihood ratio per symbol, that of its strongest window, log of its length; mean ratio per word,
    that of its strongest WORDS in a row, and of its strongest word."""
    out = np.zeros((len(texts), FEATURES))
    for i, j in groups(texts):
        s, at = symbols(texts[i:j])
        total = np.concatenate(([0], np.cumsum(tables.ratios(s)[1:])))  # from the first symbol of the first text on
        h, first = words(texts[i:j])
        ratio = tables.word_ratios(h)
        sums = np.concatenate(([0], np.cumsum(ratio)))
        for r in range(j - i):
            n = at[r + 1] - at[r] - GAP + 1
            if n <= 1:
                continue
            own = total[at[r] : at[r] + n + 1]  # its symbols and one blank after it
            w = min(WINDOW, n)
            ends = own[w::STRIDE] if n > w else own[w:]
            best = max((ends - own[: n - w + 1 : STRIDE][: len(ends)]).max(), own[n] - own[n - w])
            out[i + r, :3] = (own[n] - own[0]) / n, best / w, np.log(n)
            a, b = first[r], first[r + 1]
            if b > a:
                k = min(WORDS, b - a)
                out[i + r, 3:] = (sums[b] - sums[a]) / (b - a), (sums[a + k : b + 1] - sums[a : b + 1 - k]).max() / k, ratio[a:b].max()
    return np.round(out, 9)  # sums that differ by where a text stands in its batch


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, weights with the intercept last), by Newton steps."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) / len(y) + ridge * w
        hess = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


class Model:
    """A fitted model: the broadcast tables and the logistic function, or the share of toxic labels alone."""

    def __init__(self, share: float, tables=None, logistic=None):
        self.share, self.tables, self.logistic = share, tables, logistic

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.logistic is None:
            return np.full(len(texts), self.share)
        mean, scale, w = self.logistic
        x = (evidence(texts, self.tables.value) - mean) / scale
        return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def labelled_texts(docs: DataFrame, known: DataFrame, most: int = LABELLED, chars: int = LABELLED_CHARS) -> DataFrame:
    """(text, toxic, fold) of the sample, staged: label rows in the order of a hash, whole texts until `chars` are reached."""
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "toxic", "fold")  # a bounded broadcast
    rows = text_rows(docs).join(F.broadcast(chosen), "doc_id")
    texts = staged(rows.select(F.xxhash64("doc_id", "text").alias("h"), F.char_length("text").cast("long").alias("n"), "text", "toxic", "fold"), "labelled")
    if (texts.agg(F.sum("n")).first()[0] or 0) <= chars:
        return texts
    # Sizes are summed up by ranges of the hash (at most 16,384); the first range with texts is always taken, or else the first
    # text of it, so the sample is never empty.
    sizes = texts.groupBy(F.shiftright("h", 50).alias("r")).agg(F.sum("n").alias("n"), F.min("h").alias("first"))
    upto = sizes.select("r", F.sum("n").over(Window.orderBy("r")).alias("n")).where(F.col("n") <= chars).agg(F.max("r")).first()[0]
    if upto is None:
        return texts.where(F.col("h") == F.lit(sizes.agg(F.min("first")).first()[0]))
    return texts.where(F.shiftright("h", 50) <= F.lit(upto))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, chars: int = LABELLED_CHARS) -> Model:
    """Labels of fold 0 are not used."""
    spark = docs.sparkSession
    known = label_rows(labels).where("fold <> 0")
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = shares.get(1, 0) / max(1, sum(shares.values()))
    if len(shares) < 2:
        return Model(share)
    texts = labelled_texts(docs, known, labelled, chars)
    own = staged(labelled_grams(texts), "grams")
    wanted = staged(own.select("a").distinct(), "trigrams")
    counts = own.orderBy("a", "b").toArrow()  # at most `chars` rows
    shared = shared_counts(corpus_grams(docs), wanted).toArrow()
    spoken, every = staged(labelled_words(texts), "words"), staged(corpus_words(docs), "corpus")
    said = spoken.join(every, "w").orderBy("w").toArrow()  # at most `chars` rows
    whole = every.agg(F.sum("c")).first()[0] or 1
    discard(own, wanted, spoken, every)
    grams = Grams(counts["b"].to_numpy(), counts["a"].to_numpy(), shared)
    share_of = said["c"].to_numpy() / whole
    per = {c: (counts[c].to_numpy(), said[c].to_numpy()) for c in COUNTS}
    sums = {c: tuple(sum(per[f"{c}{k}"][i] for k in FOLDS) for i in (0, 1)) for c in "to"}

    def tables(fold: int = 0) -> Tables:
        """What all folds but one have seen."""
        seen = {c: [sums[c][i] - (per[f"{c}{fold}"][i] if fold else 0) for i in (0, 1)] for c in "to"}
        return Tables(grams.tables(seen["t"][0], seen["o"][0]), word_ratios(said["w"].to_numpy().view(np.uint64), share_of, seen["t"][1], seen["o"][1]))

    parts = []
    names = [f"x{k}" for k in range(FEATURES)]
    for k in FOLDS:  # each fold is measured by what the other folds have seen
        part = spark.sparkContext.broadcast(tables(k))

        def features(batches, part=part):
            for batch in slices(batches):
                x = evidence(batch.column("text").to_pylist(), part.value)
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), *map(pa.array, x.T)], ["toxic", *names])

        parts.append(texts.where(F.col("fold") == k).select("text", "toxic").mapInArrow(features, "toxic int, " + ", ".join(f"{n} double" for n in names)).toArrow())
        part.destroy()
    got = np.column_stack([pa.concat_tables(parts)[c].to_numpy() for c in ("toxic", *names)])
    got = got[np.lexsort(got.T[::-1])]  # the order of rows must not show in the sums
    if not 0 < got[:, 0].sum() < len(got):
        return Model(share)
    final = tables()
    del counts, per, sums, grams, said
    pa.default_memory_pool().release_unused()
    return Model(share, spark.sparkContext.broadcast(final), logistic_fit(got[:, 1:], got[:, 0]))


def score_toxicity(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, chars: int = LABELLED_CHARS) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row."""
    model = fit(docs, labels, labelled, chars)

    def score(batches):
        for batch in slices(batches):
            s = model.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = text_rows(docs).select("doc_id", "text", (fold(F.col("doc_id")) == 0).alias("held_out"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, chars: int = LABELLED_CHARS) -> DataFrame:
    """The rows of docs, all columns, whose score is below 0.5."""
    model = fit(docs, labels, labelled, chars)
    at = docs.columns.index("text")

    def keep(batches):
        for batch in slices(batches):
            s = model.scores([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(s < 0.5))

    return map_rows(docs, keep)
