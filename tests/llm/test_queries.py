"""Every query of the subpackage over the smallest tables: against its SQL, or against brute force."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from pulsegrid.llm import fingerprints, html, pii, toxicity
from pulsegrid.llm.queries import QUERIES, SQL

from .test_new_operators import brute_groups, brute_personal
from .test_text_operators import brute_base, brute_likeness, brute_markov, brute_spans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows_of(name, *columns):
    t = pq.read_table(f"{SF}/{name}.parquet", columns=list(columns))
    return list(zip(*(t[c].to_pylist() for c in columns), strict=True))


@pytest.fixture(scope="module")
def documents():
    return [(d, t or "") for d, t in rows_of("documents", "doc_id", "text")]


def test_queries_agree_with_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in SQL.items():
        got = QUERIES[name](spark, SF)
        cols = sorted(got.columns)
        r = con.execute(sql)
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        assert Counter(map(tuple, got.select(*cols).collect())) == Counter(tuple(x[names.index(c)] for c in cols) for x in r.fetchall()), name


def test_op1_packing(spark, documents):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {d: np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4") for d, x in documents}
    got = QUERIES["op1_packing"](spark, SF).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        by[r["doc_id"]].append((r["start"], r["length"]))
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, own in ids.items():
        assert sum(n for _, n in by[d]) == len(own) and sorted(by[d])[0][0] == 0
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert len(seq) == -(-sum(map(len, ids.values())) // 1024)


def test_op2_toxicity(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op2_toxicity"](spark, SF).collect()}
    assert got.keys() == {d for d, _ in documents}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for d, r in got.items())
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    want = model.scores([x for _, x in documents])
    assert np.allclose([got[d]["score"] for d, _ in documents], want, atol=1e-6)


def test_op4_fingerprints(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op4_fingerprints"](spark, SF).collect()}
    order = sorted(documents)
    assert got.keys() == {d for d, _ in order}
    for k, (d, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        cut = len(t) // 4
        e = t[: len(t) - cut] + following[:cut]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r["fingerprint"] == fingerprints.spell(fingerprints.sketch(t)) and r["edited_fingerprint"] == fingerprints.spell(fingerprints.sketch(e))
        if k % 5 == 0:  # the definition takes a second a text
            assert abs(r["near_edited"] - brute_likeness(t, e)) < 1e-12 and abs(r["near_next"] - brute_likeness(t, following)) < 1e-12


def brute_lstm(w, x):
    """The labeller's logits of one sequence, symbol by symbol."""
    h = html.HIDDEN
    s = lambda v: 1 / (1 + np.exp(-v))
    runs = {}
    for d in "fb":
        state, cell, out = np.zeros(h), np.zeros(h), [None] * len(x)
        for k in range(len(x)) if d == "f" else reversed(range(len(x))):
            g = x[k] @ w[f"x{d}"] + w[f"c{d}"] + state @ w[f"h{d}"]
            cell = s(g[h : 2 * h]) * cell + s(g[:h]) * np.tanh(g[3 * h :])
            state = s(g[2 * h : 3 * h]) * np.tanh(cell)
            out[k] = state
        runs[d] = out
    return [float(np.concatenate((a, b, v)) @ w["o"][:, 0] + w["b"][0]) for a, b, v in zip(runs["f"], runs["b"], x, strict=True)]


def test_op6_html(spark):
    pages = rows_of("pages", "page_id", "url", "html")
    got = {r["page_id"]: r for r in QUERIES["op6_html_extraction"](spark, SF).collect()}
    assert got.keys() == {p for p, _, _ in pages}
    w = {k: v.astype(float) for k, v in html.trained().items()}
    for p, url, source in pages[:40]:
        read = html.blocks(source or "")
        text = " ".join(b.text for b, z in zip(read, brute_lstm(w, html.vectors(read).astype(float)) if read else [], strict=True) if z > 0)
        assert (got[p]["url"], got[p]["text"], got[p]["n_chars"]) == (url, text, len(text))


def test_op6_long_broken_pages():
    """Unclosed tags, deep nesting and unclosed quotes: time and room in proportion to the page."""
    import time

    began = time.time()
    assert len(html.blocks("<b " * 100_000)) == 1 and html.blocks('<a "' * 100_000)
    deep = html.blocks("<div>x" * 50_000)
    assert len(deep) == 50_000 and html.vectors(deep[-3:]).shape[0] == 3
    assert html.blocks("<b>" * 100_000 + "<div></div>" * 30_000 + "</i>" * 100_000 + "</p>" * 50_000) == []
    assert [b.text for b in html.blocks("<b> " * 100_000 + "end")] == ["end"]
    assert time.time() - began < 20


def test_op8_decontamination(spark, documents):
    """All pairs by greedy tiling from the definition."""
    import re

    cut = lambda t: re.findall(r"[^\x09-\x0d\x20-/:-@\[-`{-~]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [(i, cut(t)) for i, t in rows_of("benchmark", "item_id", "text")]
    want = set()
    for d, t in documents:
        words = cut(t)
        seeds = {tuple(words[i : i + 4]) for i in range(len(words) - 3)}
        for i, p in items:
            k = min(4, len(p))
            if not p or (k == 4 and sum(tuple(p[j : j + 4]) in seeds for j in range(len(p) - 3)) == 0):
                continue
            mp, mt, total = [False] * len(p), [False] * len(words), 0
            while True:
                best = None
                for a in range(len(p)):
                    for b in range(len(words)):
                        n = 0
                        while a + n < len(p) and b + n < len(words) and p[a + n] == words[b + n] and not mp[a + n] and not mt[b + n]:
                            n += 1
                        if n >= k and (best is None or n > best[0]):
                            best = (n, a, b)
                if best is None:
                    break
                n, a, b = best
                mp[a : a + n], mt[b : b + n] = [True] * n, [True] * n
                total += n
            if total >= 0.5 * len(p):
                want.add((d, i, round(total / len(p), 9)))
    got = {(r["doc_id"], r["item_id"], round(r["coverage"], 9)) for r in QUERIES["op8_decontamination"](spark, SF).collect()}
    assert got == want


def test_op9_secrets(spark, documents):
    from pulsegrid.llm import secrets

    got = {r["doc_id"]: r for r in QUERIES["op9_secrets"](spark, SF).collect()}
    rows = secrets.text_rows(spark.read.parquet(f"{SF}/documents.parquet"))
    ratios = secrets.train(rows, secrets.scan(rows))
    assert got.keys() == {d for d, _ in documents}
    for d, t in documents:
        base, r = brute_base(t), got[d]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
        places = [tuple(map(int, b.split(":")[1:])) for b in base]
        added = [f"markov:{a}:{b}" for a, b in brute_markov(t, ratios) if not any(x < b and a < y for x, y in places)]
        assert Counter(r["spans"].split(",") if r["spans"] else []) == Counter([*base, *added])


def test_op10_substrings(spark, documents):
    """What the definition removes, and after that no sentence run of 20 words is left in two documents but in the first."""
    got = {r["doc_id"]: r for r in QUERIES["op10_substring_dedup"](spark, SF).collect()}
    gone, parts = brute_spans(documents, whole=True)
    assert got and got.keys() == {d for (d, _), s in gone.items() if s}
    for (d, t), s in gone.items():
        assert (got[d]["n_sentences"], got[d]["n_removed"]) == (len(parts[d, t]), len(s))
        assert got[d]["text"].split() == [w for k, x in enumerate(parts[d, t]) if k not in s for w in x]
    again = brute_spans([(d, got[d]["text"] if d in got else t) for d, t in documents], whole=True)[0]
    left = {k: v for k, v in again.items() if v}
    # Sentences that come to stand side by side by a removal may make a new run; no run of the given texts is left.
    assert all(d in got for d, _ in left)


def test_op11_alignment(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op11_alignment"](spark, SF).collect()}
    groups = {d: brute_groups(t) for d, t in documents}
    links = {d: [(a, b) for x, y in g for a in x for b in y] for d, g in groups.items()}
    held = Counter(p for own in links.values() for p in set(own))
    high = {}
    for (a, _), n in held.items():
        high[a] = max(high.get(a, 0), n)
    assert got.keys() == groups.keys()
    for d, g in groups.items():
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        r = got[d]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links[d]))
        assert r["groups_sha256"] == (hashlib.sha256(text.encode()).hexdigest() if g else "")
        assert r["n_best"] == sum(held[p] == high[p[0]] for p in links[d]) and r["count_sum"] == sum(held[p] for p in links[d])


def test_op13_pii(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op13_pii"](spark, SF).collect()}
    assert got.keys() == {d for d, _ in documents}
    total = Counter()
    for d, t in documents:
        base, r = brute_personal(t), got[d]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[1] == k for b in base) for k in range(4)]
        spelt = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(spelt).encode()).hexdigest() and set(spelt) <= set(r["spans"].split(","))
        total["more"] += len([x for x in r["spans"].split(",") if x.startswith("model_")])
    assert total["more"] <= 3  # the base rules know what these texts hold
