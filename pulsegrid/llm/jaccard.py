"""N-gram Jaccard join: multiple-global-order filtering.

If two sets of sizes m and n link (intersection >= 0.75 union), then under ANY total order of tokens the first
n - ceil(0.75 n) + l tokens of one and as many of the other share l tokens (l at most either's LEAD-th part; a prefix).
Three independent orders are used, and their filters are intersected before any whole set is looked at:

1. order 2, a hash of the token, on single sets: a set goes on only if l tokens of its prefix are in some other set at all.
   The prefixes of all documents are shuffled once by token. What most corpora consist of, texts that share passages but
   are no copies, ends here;
2. order 1, rare tokens first (estimated document frequency, then another hash): pairs that share a token of their shortest
   prefixes (l = 1), at places that leave room for enough more (positional filter), are candidates;
3. orders 2 and 3 (a third hash) on pairs: a candidate must share l tokens of its prefixes under both; its token counts in
   256 hash buckets, an upper bound of the intersection, must leave room as well.

Only what passes all of them is verified on whole sets, exactly and without a cap. The frequency estimate comes from a hash
sample of texts and only shapes order 1 and spares tokens known to be shared the shuffle: neither the sample nor the bound
on its table (FREQUENT) can change a result.

Candidates never are all pairs of a token's documents. A node is a distinct set (copies share one). For each shared token its
nodes are compared with a few hubs first, which costs some pairs per row; linked nodes form components, and then only leading
nodes are compared with nodes of other components. So groups of near copies cost rows, not squares, and no link between
components is lost. Whether hubs go before (they do where many pairs are left) decides cost, not results.

Defined results: null or wordless text has n_shingles 0 and is linked with nothing; fewer than 5 words form one shingle;
equal texts link; repeated rows link with themselves; a null doc_id counts for links but never is a component's least;
an empty table gives no rows; other columns are ignored. Sets and tokens are compared as 64-bit hashes: among 10^10 distinct
sets about 3 pairs share a hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.components import connected_components

from .common import discard, quoted, slices, staged, text_rows, unused
from .textvec import mix, shingle_sets

WORDS, PERCENT = 5, 75
LEAD = 12
SAMPLE, FREQUENT = 16, 1_000_000
ROUNDS, SMALL, HUBS = 1, 32, 4
BEFORE = 4
BUCKETS = 256
BROADCAST_ROWS = 1_000_000


def prefix_length(n: int, percent: int = PERCENT, shared: int = 1) -> int:
    """How many tokens hold `shared` of those of any similar set."""
    return n - (percent * n + 99) // 100 + shared


def lead(n: int) -> int:
    """How many tokens two similar sets must share within their prefixes under orders 2 and 3."""
    return max(1, n // LEAD)


def set_signature(tokens: np.ndarray) -> int:
    return int(mix(np.array([mix(tokens, 5).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64), 6).view(np.int64)[0])


def _frequent(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The FREQUENT most frequent tokens of the sample (at least twice), with their counts: at most 16 MB."""

    def tokens(batches):
        for batch in slices(batches):
            got = [s for _, s in shingle_sets(batch.column("text"), words)]
            t = np.concatenate(got) if got else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64))], ["tok"])

    some = rows.where(F.pmod("th", F.lit(SAMPLE)) == 0).dropDuplicates(["th"]).select("text")
    counted = some.mapInArrow(tokens, "tok long").groupBy("tok").agg(F.count("*").alias("n")).where("n > 1")
    top = counted.orderBy(F.desc("n"), "tok").limit(FREQUENT).toArrow()
    t, n = top["tok"].to_numpy().view(np.uint64), np.minimum(top["n"].to_numpy(), 255).astype(np.uint8)
    by = np.argsort(t)
    return t[by], n[by]


def _order_one(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    h = mix(tokens, 1) >> np.uint64(8)
    known, count = frequent
    if len(known):
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        h |= np.where(known[at] == tokens, count[at], 0).astype(np.uint64) << np.uint64(56)
    return h


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, th (hash of its text), n_shingles, component_id (least doc_id reachable by links), and
    keep (whether it is the one that stands for its component; repeated rows share the verdict)."""
    spark = docs.sparkSession
    rows = text_rows(docs).withColumn("th", F.xxhash64("text")).withColumn("rk", F.xxhash64("doc_id", "th"))
    frequent = spark.sparkContext.broadcast(_frequent(rows, words))

    def prefixes(batches):
        seen: set[int] = set()  # signatures of this task's documents: a copy adds no tokens
        for batch in slices(batches):
            sigs, sizes, known, toks = [], [], [], []
            for _, s in shingle_sets(batch.column("text"), words):
                sizes.append(len(s))
                known.append(0)
                toks.append(None)
                sigs.append(set_signature(s) if len(s) else None)
                if not len(s) or sigs[-1] in seen:
                    continue
                seen.add(sigs[-1])
                by, p = mix(s, 2), prefix_length(len(s), percent, lead(len(s)))
                first = s[np.argpartition(by, p - 1)[:p]]
                shared = _is_known(first, frequent.value[0])
                known[-1] = int(shared.sum())
                toks[-1] = first[~shared]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), batch.column("rk"), pa.array(sigs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), _lists(toks)], ["doc_id", "th", "rk", "sig", "n", "known", "toks"])

    wide = staged(rows.mapInArrow(prefixes, "doc_id long, th long, rk long, sig long, n long, known long, toks array<long>"), "prefix")
    base = staged(wide.drop("toks"), "base")
    # One shuffle tells which tokens several sets hold. Those of great groups are known from the sample and not in it.
    every = Window.partitionBy("tok")
    tokens = wide.where("size(toks) > 0").select(F.explode("toks").alias("tok"), "sig").select("sig", (F.min("sig").over(every) < F.max("sig").over(every)).alias("shared"))
    found = tokens.where("shared").groupBy("sig").agg(F.count("*").alias("found"))
    nodes = base.where("sig is not null").groupBy("sig").agg(F.min("rk").alias("rk"), F.max("n").alias("n"), F.max("known").alias("known"))
    enough = F.coalesce("found", F.lit(0)) + F.col("known") >= F.greatest(F.lit(1), F.floor(F.col("n") / LEAD))
    chosen = staged(nodes.join(found, "sig", "left").where(enough).select("rk"), "nodes")
    discard(wide)
    sets = _sets(rows, chosen, words)
    narrow = staged(sets.mapInArrow(_narrow(percent, frequent), "sig long, n int, toks array<long>, two binary, three binary, counts binary, odd array<long>"), "orders")
    tokens = narrow.select(F.posexplode("toks").alias("i", "tok"), "sig", "n").select("tok", "sig", "n", "i")
    # What is joined is written first, so that both sides of the join are plain shuffles, which AQE splits under skew.
    near = F.max(_leading("n", "i", percent).cast("int"))
    shared = staged(tokens.groupBy("tok").agg(F.count("*").alias("m"), near.alias("near")).where("m > 1 and near = 1").select("tok"), "tokens")
    active = staged(tokens.join(shared, "tok", "left_semi"), "shared")
    labels = _link(active, narrow, sets, percent)
    discard(chosen, shared, sets, narrow)
    named = base.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("d"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("first"))
    named = named.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    of = named.groupBy("root").agg(F.min("d").alias("component_id"), F.min("first").alias("first"))
    verdict = staged(named.select("sig", "root").join(of, "root").select("sig", "component_id", F.col("first.doc_id").alias("fd"), F.col("first.th").alias("ft")), "verdict")
    out = base.select("doc_id", "th", "sig", F.col("n").alias("n_shingles")).join(_few(verdict), "sig", "left")  # beyond the broadcast AQE splits a great group of copies
    keep = F.col("sig").isNull() | (F.col("doc_id").eqNullSafe(F.col("fd")) & (F.col("th") == F.col("ft")))
    return out.select("doc_id", "th", "n_shingles", F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), keep.alias("keep"))


def _few(df: DataFrame) -> DataFrame:
    """df (staged), to be broadcast if it has no more than BROADCAST_ROWS rows, else to be merged."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("merge")


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    n = np.array([0 if t is None else len(t) for t in arrays], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *[t for t in arrays if t is not None]]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(flat))


def _is_known(tokens: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(tokens), bool)
    return known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens


def _sets(rows: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """(sig, n, toks): the whole sets of the chosen rows (rk), tokens ascending."""

    def whole(batches):
        for batch in slices(batches):
            got = [s for _, s in shingle_sets(batch.column("text"), words) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_signature(s) for s in got], pa.int64()), pa.array([len(s) for s in got], pa.int32()), _lists(got)], ["sig", "n", "toks"])

    texts = rows.join(_few(chosen), "rk", "left_semi").select("text")
    return staged(texts.mapInArrow(whole, "sig long, n int, toks array<long>"), "sets")  # a repeated row repeats links only


def _narrow(percent: int, frequent):
    """What the filters need of each set: its prefix under order 1, 32-bit hashes of those under orders 2 and 3, its
    counts by bucket, and whether they are odd."""

    def work(batches):
        for batch in slices(batches):
            toks, two, three, counts, odd = [], [], [], [], []
            column = batch.column("toks")
            off, flat = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
            for a, b in zip(off[:-1], off[1:], strict=True):
                s = flat[a:b]
                p = prefix_length(len(s), percent)
                by = _order_one(s, frequent.value)
                first = np.argpartition(by, p - 1)[:p]
                toks.append(s[first[np.argsort(by[first])]])
                p = prefix_length(len(s), percent, lead(len(s)))
                for out, salt in ((two, 2), (three, 3)):
                    out.append((np.partition(mix(s, salt), p - 1)[:p] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())
                by = np.bincount((mix(s, 4) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                counts.append(np.minimum(by, 255).astype(np.uint8).tobytes())
                odd.append(np.packbits((by & 1).astype(bool)).view(np.int64))
            parity = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([np.zeros(0, np.int64), *odd])), BUCKETS // 64).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("sig"), batch.column("n"), _lists(toks), *(pa.array(x, pa.binary()) for x in (two, three, counts)), parity], ["sig", "n", "toks", "two", "three", "counts", "odd"])

    return work


def _only(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of sets whose sig is among the nodes (staged)."""
    return sets.join(_few(nodes), "sig", "left_semi")


def _plausible(pairs: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share enough of their prefixes under orders 2 and 3, and whose counts by bucket leave room
    for an intersection that is large enough."""
    columns = ("n", "two", "three", "counts")
    one = vectors.select(F.col("sig").alias("a"), *(F.col(c).alias(f"{c}_a") for c in columns))
    two = vectors.select(F.col("sig").alias("b"), *(F.col(c).alias(f"{c}_b") for c in columns))

    def bound(batches):
        for batch in slices(batches, 128):
            if not batch.num_rows:
                continue
            ca, cb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16) for c in ("counts_a", "counts_b"))
            na, nb = (batch.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
            d = ca - cb
            most = np.minimum(na - np.maximum(d, 0).sum(1), nb - np.maximum(-d, 0).sum(1))
            ok = 100 * most >= percent * (na + nb - most)
            for order in ("two", "three"):
                x, y = batch.column(f"{order}_a"), batch.column(f"{order}_b")
                for r in np.flatnonzero(ok).tolist():
                    p, q = (np.frombuffer(v[r].as_buffer(), np.uint32) for v in (x, y))
                    # Tokens are counted one by one, so a shared 32-bit hash can only let a pair pass.
                    least = min(lead(int(na[r])), lead(int(nb[r])))
                    ok[r] = np.isin(p, q).sum() >= least
            yield batch.select(["a", "b", "ca", "cb"]).filter(pa.array(ok))

    held = pairs.join(one, "a").join(two, "b").select("a", "b", "ca", "cb", *(f"{c}_{x}" for c in columns for x in "ab"))
    return held.mapInArrow(bound, "a long, b long, ca long, cb long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough."""
    one = sets.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
    two = sets.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(one, "a").join(two, "b").where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("ca", "cb")


def _leading(n: str, i: str, percent: int):
    """Whether a token at place i of n (order 1) can be the first that its set shares with one no smaller."""
    return (100 + percent) * F.col(i) <= (100 - percent) * F.col(n)


def _room(n1: str, i1: str, n2: str, i2: str, percent: int):
    """Whether two sets whose first shared token stands at these places can still share enough. Similar sets pass it
    at the first token that they share, so no link is lost."""
    n1, n2 = F.col(n1), F.col(n2)
    return (100 + percent) * F.least(n1 - F.col(i1), n2 - F.col(i2)) >= percent * (n1 + n2)


def _close(n1: str, odd1: str, n2: str, odd2: str, percent: int):
    """Whether two sets may differ in few enough tokens: each bucket whose count is odd in one of them alone holds a token
    that the other lacks. No link is lost."""
    differ = sum((F.bit_count(F.col(odd1)[k].bitwiseXOR(F.col(odd2)[k])) for k in range(1, BUCKETS // 64)), F.bit_count(F.col(odd1)[0].bitwiseXOR(F.col(odd2)[0])))
    return (100 + percent) * differ <= (100 - percent) * (F.col(n1) + F.col(n2))


def _apart(rows: DataFrame, percent: int) -> DataFrame:
    """What shares a token across components, the smaller set leading. Similar sets need it only at the first token that they
    share, so a pair is not made where one of the few tokens before is shared as well: near copies, which share most of their
    prefixes, make about one row a pair and not one a token."""
    other = rows.select("tok", F.col("sig").alias("s2"), F.col("n").alias("n2"), F.col("i").alias("i2"), F.col("odd").alias("odd2"), F.col("comp").alias("c2"), F.col("before").alias("before2"))
    ordered = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("sig") < F.col("s2")))
    pairs = rows.where(_leading("n", "i", percent)).join(other, "tok").where(ordered & (F.col("comp") != F.col("c2")) & ~F.arrays_overlap("before", "before2"))
    return pairs.where(_room("n", "i", "n2", "i2", percent) & _close("n", "odd", "n2", "odd2", percent))


def _link(active: DataFrame, narrow: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) of active nodes (active is discarded). Links are contracted as they are found, so each round only
    sees components that still share a token; hubs go on until few pairs are left apart, or for ROUNDS rounds."""
    # A set in the middle of its near copies has few tokens of its own, and so links with more of them than they do.
    p = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1
    own = active.groupBy("sig").agg((100 * (1 - F.count("*") / F.max(p))).cast("int").alias("alone"))
    own = own.join(narrow.select("sig", "odd"), "sig")
    rows = staged(active.join(own, "sig").select("tok", "sig", "n", "i", "odd", "alone", F.col("sig").alias("comp")), "rows")
    labels = staged(active.groupBy(F.col("sig").alias("node")).agg(F.min("sig").alias("root")), "roots")
    discard(active)
    done, kept = None, []
    for turn in range(ROUNDS + 1):
        # Hubs: of the leading sets the one with the fewest tokens of its own, and HUBS that hashes choose for each token.
        leads = _leading("n", "i", percent)
        hub = F.struct("sig", "n", "i", "odd", "comp")
        ranks = [F.struct("alone", F.xxhash64("sig")), *(F.xxhash64("sig", "tok", F.lit(turn), F.lit(k)) for k in range(HUBS))]
        hubs = F.array(*(F.min_by(hub, F.struct((~leads).alias("late"), r.alias("by"))) for r in ranks))
        groups = rows.groupBy("tok").agg(F.count("*").alias("m"), F.sum(leads.cast("long")).alias("near"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), hubs.alias("hubs"))
        groups = staged(groups.where("lo <> hi and near > 0").select("tok", "m", "near", "hubs"), "groups")
        size = groups.agg(F.sum("m").alias("rows"), F.sum(F.col("m") * F.col("near")).alias("squares")).first()  # at most so many pairs
        if not size["rows"]:
            discard(rows, groups)
            break
        last = turn == ROUNDS or size["squares"] <= SMALL * size["rows"]
        # A token whose sets are of one component, or that leads in none, is done with.
        open_rows = rows.join(groups.select("tok"), "tok", "left_semi")
        if last:
            open_rows = open_rows.withColumn("before", F.collect_list("tok").over(Window.partitionBy("sig").orderBy("i").rowsBetween(-BEFORE, -1)))  # few tokens, so rows stay small
        open_rows = staged(open_rows, "open")
        discard(rows)
        if last:
            pairs = _apart(open_rows, percent)
            one, two = F.struct(F.col("sig").alias("s"), F.col("comp").alias("c")), F.struct(F.col("s2").alias("s"), F.col("c2").alias("c"))
            first = F.col("sig") < F.col("s2")
        else:
            pairs = open_rows.join(groups.select("tok", "hubs"), "tok").withColumn("hub", F.explode(F.array_distinct("hubs"))).drop("hubs")
            pairs = pairs.where((F.col("comp") != F.col("hub.comp")) & _room("n", "i", "hub.n", "hub.i", percent) & _close("n", "odd", "hub.n", "hub.odd", percent))
            one, two = F.struct(F.col("sig").alias("s"), F.col("comp").alias("c")), F.struct(F.col("hub.sig").alias("s"), F.col("hub.comp").alias("c"))
            first = F.col("sig") < F.col("hub.sig")
        pairs = pairs.select(F.when(first, one).otherwise(two).alias("p"), F.when(first, two).otherwise(one).alias("q"))
        pairs = pairs.select(F.col("p.s").alias("a"), F.col("q.s").alias("b"), F.col("p.c").alias("ca"), F.col("q.c").alias("cb"))
        pairs = pairs.groupBy("a", "b").agg(F.min("ca").alias("ca"), F.min("cb").alias("cb"))
        pairs = staged(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        nodes = staged(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), "ends")
        likely = staged(_plausible(pairs, _only(narrow, nodes), percent), "likely")
        links = staged(_verified(likely, _only(sets, nodes), percent), "links")
        moved = connected_components(links, staged, "ca", "cb", discard)
        moved_to = moved.select(F.col("node").alias("comp"), F.col("root").alias("to"))
        old, labels = labels, staged(labels.withColumnRenamed("root", "comp").join(_few(moved_to), "comp", "left").select("node", F.coalesce("to", "comp").alias("root")), "roots")
        discard(old)
        kept.append(pairs)
        if not last:
            rows = staged(open_rows.join(_few(moved_to), "comp", "left").select("tok", "sig", "n", "i", "odd", "alone", F.coalesce("to", "comp").alias("comp")), "rows")
            done = pairs.select("a", "b") if done is None else done.unionByName(pairs.select("a", "b"))
        discard(groups, open_rows, nodes, likely, links, moved)  # what is needed of them is written, so nothing reads these again
        if last:
            break
    discard(*kept)
    return labels


def without_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, that stand for their components: the least doc_id of each, once."""
    gone = staged(near_duplicates(docs, words, percent).groupBy("doc_id", "th").agg(F.min("keep").alias("keep"), F.count("*").alias("copies")), "verdicts")
    id_, th = unused(docs, "id", "th")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn(th, F.xxhash64(text))
    mine = F.col("doc_id").cast("long").eqNullSafe(F.col(id_))
    select = lambda rows: staged(gone.where(rows).select(F.col("doc_id").alias(id_), F.col("th").alias(f"{th}_")), "keys")
    on = [mine, F.col(th) == F.col(f"{th}_")]
    left = keyed.join(_few(select("not keep")), on, "left_anti")
    # Rows that repeat in full are copies of each other too. They are rare: only where any are kept are rows compared.
    again = select("keep and copies > 1")
    if again.isEmpty():
        return left.select(*map(quoted, docs.columns))
    again = _few(again)
    empty = ~text.rlike(r"[^\x20\x09-\x0D]")
    twice = left.join(again, on, "left_semi")
    once = twice.where(~empty).dropDuplicates(["doc_id", th])
    return left.join(again, on, "left_anti").unionByName(once).unionByName(twice.where(empty)).select(*map(quoted, docs.columns))
