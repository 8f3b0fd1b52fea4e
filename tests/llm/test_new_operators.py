"""Cross-tokenizer alignment, importance resampling, personal data: brute force, odd tables, held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from pulsegrid.llm import alignment, pii, resampling

from .test_text_operators import ODD, table, words

# --- alignment -------------------------------------------------------------------------------------------------------


def brute_groups(text):
    """[(A ids, B ids)] from the tokenizers' ends."""
    encode_a, va, encode_b, vb = alignment.tokenizers()
    if not text:
        return []
    sides, whole = [], (" " + text).encode()
    for ids, v in ((encode_a(text), va), (encode_b(text), vb)):
        if b"".join(v.spelt[i] for i in ids) != whole:
            return []
        at, ends = 0, []
        for i in ids:
            at += len(v.spelt[i])
            ends.append(at)
        sides.append((ids, ends))
    out, i, j = [], 0, 0
    (a, pa_), (b, pb) = sides
    for cut in sorted(set(pa_) & set(pb)):
        x, y = i, j
        while i < len(pa_) and pa_[i] <= cut:
            i += 1
        while j < len(pb) and pb[j] <= cut:
            j += 1
        out.append((a[x:i], b[y:j]))
    return out


TEXTS = ["hello world", "", "  a  b\n\tc  ﬁ é日本語 🎉🎉", "x▁y", "<|endoftext|> </s> <0x41>", "a" * 300, " " * 50, "日本語テキスト 日本語", "🎉" * 90, "ÀÉ́ naïve"]


def test_groups_and_pairs_are_those_of_the_definition(monkeypatch):
    for wide in (alignment.WIDE, 3):  # the second takes every long group by its distinct ids
        monkeypatch.setattr(alignment, "WIDE", wide)
        x = alignment.Aligned(TEXTS)
        first, codes, times = x.pairs()
        for k, (text, spelt) in enumerate(zip(TEXTS, x.strings(), strict=True)):
            want = brute_groups(text)
            assert spelt.decode() == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)
            pairs = Counter(a << alignment.SHIFT | b for p, q in want for a in p for b in q)
            assert dict(zip(codes[first[k] : first[k + 1]].tolist(), times[first[k] : first[k + 1]].tolist(), strict=True)) == pairs
            assert x.n_links[k] == sum(pairs.values()) and x.n_groups[k] == len(want)


def test_components_of_chains():
    n = 500  # one chain through all nodes
    root = alignment.components(n, n, np.repeat(np.arange(n), 2)[1:], np.repeat(np.arange(n), 2)[:-1])
    assert (root == 0).all()


def test_alignment_counts_over_chunks(spark, monkeypatch):
    rng = random.Random(1)
    rows = [*ODD, *((20 + k, t) for k, t in enumerate(TEXTS)), *((50 + k, words(rng, rng.randint(1, 200))) for k in range(40))]
    rows += [(200 + k, rows[-1][1]) for k in range(20)]
    df = table(spark, rows).selectExpr("doc_id", "text", "doc_id as `a.b`", "text as pairs")
    got = alignment.align_documents(df.repartition(5), spell=True).collect()
    groups = [(d, brute_groups(t)) for d, t in rows]
    links = [(d, [(a, b) for p, q in g for a in p for b in q], g) for d, g in groups]
    held = Counter(p for _, own, _ in links for p in set(own))
    high = {}
    for (a, _), n in held.items():
        high[a] = max(high.get(a, 0), n)
    want = Counter()
    for d, own, g in links:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g)
        want[d, sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), len(own), sum(held[p] == high[p[0]] for p in own), sum(held[p] for p in own), text] += 1
    assert Counter(tuple(r) for r in got) == want
    assert {(r["a_id"], r["b_id"]): r["n_docs"] for r in alignment.pair_counts(df).collect()} == held
    assert alignment.align_documents(table(spark, [])).count() == 0


# --- resampling ------------------------------------------------------------------------------------------------------


def brute_scores(rows, target, longest=1, buckets=resampling.BUCKETS, seed=resampling.SEED):
    def grams(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    key = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(key(g) for _, t in rows for g in grams(t)[1])
    t = Counter(key(g) for x in target for g in grams(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (ns + buckets) / ((s[k] + 1) * (nt + buckets))))
    out = []
    for d, text in rows:
        w, g = grams(text)
        weight = sum(map(gain, map(key, g))) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    return out


def test_resampling_by_brute_force(spark):
    rng = random.Random(2)
    rows = [*ODD, *((100 + k, words(rng, rng.randint(0, 60))) for k in range(400)), (900, "x" * 70 + " " + "y" * 24 + " " + "z" * 25 + " Ünï-code" * 30), (901, "\x00\x7f a_b{c}" * 20)]
    rows += [(7, "a b c d e f " * 40)] * 30  # ties in score and id
    target = [words(rng, 80), None, "a b c a b"]
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    for longest in (1, 2):
        got = resampling.resample(table(spark, rows).selectExpr("*", "text as `a.b`", "1 as score"), aim, longest=longest).collect()
        want = brute_scores(rows, target, longest)
        assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter(w[:4] for w in want)
        open_ = sorted(((-w[3], -1 if w[0] is None else w[0]) for w in want if w[4] >= resampling.LEAST))
        ranked = sorted((r["rank"], -r["score"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got if r["rank"] is not None)
        assert [r[1:] for r in ranked] == open_[: len(open_) * 10 // 100] and [r[0] for r in ranked] == list(range(1, len(ranked) + 1))
    assert resampling.resample(table(spark, []), aim).count() == 0
    assert resampling.resample(table(spark, ODD), aim.limit(0)).where("rank is not null").count() == 0
    assert {r["doc_id"] for r in resampling.drawn_documents(table(spark, rows), aim).collect()} >= {r["doc_id"] for r in resampling.resample(table(spark, rows), aim).where("rank = 1").collect()}


def test_draws_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE", 40)
    rng = random.Random(3)
    rows = [(k, words(rng, 30)) for k in range(1500)]
    got = resampling.resample(table(spark, rows).repartition(7), spark.createDataFrame([(1, words(rng, 50))], "item_id long, text string"), share=37).collect()
    order = sorted(got, key=lambda r: (-r["score"], r["doc_id"]))
    assert [r["rank"] for r in order] == [*range(1, 556), *[None] * 945]


def test_tournament_merges_and_stops():
    rng = np.random.default_rng(4)
    runs = []
    for k in range(23):
        n = int(rng.integers(1, 20_000)) if k % 3 else int(rng.integers(1, 100))
        rows = np.stack([rng.integers(0, 50, n), rng.integers(0, 9, n), np.zeros(n, np.int64), np.full(n, k), np.arange(n), np.zeros(n, np.int64)], 1)
        rows = rows[resampling.order(rows)]
        rows[:, 4] = np.arange(n)
        runs.append(rows[resampling.order(rows)])
    tree, got = resampling.tournament(runs), []
    while (b := tree.block()) is not None:
        got.append(b)
    whole = np.concatenate(runs)
    assert np.array_equal(np.concatenate(got), whole[resampling.order(whole)])
    tree = resampling.tournament(runs)
    tree.block()
    assert sum(p.at < len(p.rows) for p in leaves(tree)) > 5  # what is not asked for is not read


def leaves(node):
    return [node] if isinstance(node, resampling.Run) else [x for p in node.players for x in leaves(p)]


def test_features_of_long_words():
    texts = ["", "A" * 24 + " " + "b" * 25 + " " + "C" * 300 + " é" * 3, "\x00", "x-Y_z" * 5]
    seen = [[] for _ in texts]
    for i, first, marks in resampling.features(pa.array(texts)):
        for k in range(len(first) - 1):
            seen[i + k] += marks[first[k] : first[k + 1]].tolist()
    assert seen == [[zlib.crc32(w.encode()) % resampling.BUCKETS for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.replace("A", "a").replace("C", "c").replace("Y", "y"))] for t in texts]


# --- personal data ---------------------------------------------------------------------------------------------------


def brute_personal(text):
    """The base rules by the contract's patterns."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(d[::-1])) % 10 == 0

    out = []
    for k, (pattern, ok) in enumerate((
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if ok(m[0])]
    return sorted(out)


def test_base_rules_by_the_patterns():
    rng = random.Random(5)
    pool = ["a", "b9", "@", ".", "-", "+", " ", "1", "22", "333", "4111 1111 1111 1111", "(", ")", "x@y.zz", "10.0.0.1", "é", "%", "_", "\n", "0001", "@@", "..", "4111111111111111"]
    for _ in range(4000):
        text = "".join(rng.choices(pool, k=rng.randint(0, 14)))
        assert pii.base_spans(text) == brute_personal(text), text
    long = "a" * 200_000 + "1" * 200_000 + "." * 50_000 + "+1" + " " * 100_000  # in linear time
    assert pii.base_spans(long) == []


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    net = pii.Tagger.fresh(rng)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    codes, tags = (v[:14] for v in pii.labelled(random.Random(3), 4))
    _, grads = net.gradients(codes, tags)
    for name, g in grads.items():
        i = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, value = net.w[name][i], []
        for h in (1e-4, -1e-4):
            net.w[name][i] = old + h
            value.append(net.gradients(codes, tags)[0])
        net.w[name][i] = old
        assert abs((value[0] - value[1]) / 2e-4 - g[i]) < 1e-2 * max(1, abs(g[i])), name


def test_decoding_is_the_best_path():
    net = pii.Tagger.fresh(np.random.default_rng(2))
    codes = np.random.default_rng(3).integers(0, 130, (4, 3))
    got, e, trans = net.decode(codes), net.emissions(codes), net.w["t"] + pii._allowed()
    paths = np.stack(np.meshgrid(*[np.arange(pii.TAGS)] * 4, indexing="ij"), -1).reshape(-1, 4)
    for j in range(3):
        s = net.w["s"][paths[:, 0]] + sum(e[k, j, paths[:, k]] for k in range(4)) + sum(trans[paths[:, k], paths[:, k + 1]] for k in range(3))
        assert np.isclose(s.max(), s[(paths == got[:, j]).all(1)][0], atol=1e-4)


def test_personal_data_of_unseen_texts(spark):
    net, maker = pii.Tagger(pii.trained()), pii.Maker(random.Random(77))
    found, known = Counter(), Counter()
    texts, spans = zip(*(maker.example(300) for _ in range(200)), strict=True)
    for text, want, got in zip(texts, spans, pii.find_spans(list(texts), net), strict=True):
        for s, k, e in want:
            if pii._right(pii.TAGGED[k], text[s:e]):
                known[k] += 1
                found[k] += any(a <= s + 2 and e - 2 <= b for a, _, b in got)
    print({pii.TAGGED[k]: (found[k], n) for k, n in known.items()})
    assert sum(found.values()) > 0.85 * sum(known.values())
    # Windows that are left out hold nothing.
    some = [" ".join(words(random.Random(k), 120) + " " + t for t in texts[k : k + 3]) + words(random.Random(k), 400) for k in range(0, 60, 3)]
    assert pii.find_spans(some, net) == pii.find_spans(some, net, everywhere=True)
    # Clean texts are left alone.
    plain = [words(random.Random(k), 500) + f" 2024-05-{k % 28 + 1:02} {k}.5 v1.2.{k} {'0123456789abcdef' * 2}" for k in range(60)]
    assert sum(k >= len(pii.KINDS) for spans in pii.find_spans(plain, net) for _, k, _ in spans) <= 1
    rows = [*ODD, (30, "write to jan.kowalski [at] example [dot] org, call (509) 555-6973 or +1 (509) 555-6973"), (31, "10.0.0.256 4111111111111112"), (32, "x" * 100_000 + " a@b.cd " + "é" * 1000)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(table(spark, rows).selectExpr("*", "text as `a.b`", "1 as spans")).collect()}
    assert len(got) == len({d for d, _ in rows}) and [s["value"] for s in got[32]] == ["a@b.cd"] and not got[31] and got[1] == []
    assert [(s["kind"], s["value"]) for s in got[30]] == [("model_email", "jan.kowalski [at] example [dot] org"), ("model_phone", "(509) 555-6973"), ("phone", "+1 (509) 555-6973")]
    assert pii.find_personal_data(table(spark, [])).count() == 0
