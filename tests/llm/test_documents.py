"""The Jaccard join against brute force, toxicity and HTML on planted data, and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pulsegrid.llm import html, jaccard, toxicity

from .test_text_operators import ODD, table, words


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(rows):
    """{(doc, text): (size, least doc of its component)} by comparing all pairs."""
    rows = list(dict.fromkeys(rows))
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return {rows[i]: (len(sets[i]), least.get(find(i)) if sets[i] else rows[i][0]) for i in range(len(rows))}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = words(rng, 1)
    return " ".join(w)


def corpus(seed):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(20, 120)) for _ in range(12)]
    passage = words(rng, 40)
    rows = [(k, t) for k, t in enumerate(ODD_TEXTS)]
    for k in range(110):
        b = rng.choice(base)
        kind = rng.random()
        rows.append((100 + k, b if kind < 0.2 else edited(rng, b, rng.randint(1, 4)) if kind < 0.7 else passage + " " + words(rng, rng.randint(1, 60)) if kind < 0.9 else words(rng, rng.randint(1, 9))))
    chain = words(rng, 200).split()  # each links with its neighbours alone
    for k in range(12):
        chain = chain[6:] + words(rng, 6).split()
        rows.append((400 - k, " ".join(chain)))
    return rows


ODD_TEXTS = [None, "", " \n", "one two", "One  TWO", "a b c d e", "a b c d e", "é ß 😀"]


@pytest.mark.parametrize(("seed", "rounds", "small"), [(1, 8, 8), (2, 0, 8), (3, 8, 0)])
def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch, seed, rounds, small):
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)  # hubs until done, all at once, or hubs as long as they help
    monkeypatch.setattr(jaccard, "SMALL", small)
    rows = [*corpus(seed), (None, "a null id here and more words"), (9000, "a null id here and more words")]
    docs = table(spark, rows).repartition(3)
    want = components(rows)
    got = jaccard.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter((d, *want[d, t]) for d, t in rows)
    assert Counter(want[r].__getitem__(1) for r in want if want[r][0]).most_common(1)[0][1] > 8
    kept = jaccard.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    left = [r["doc_id"] for r in kept.collect()]
    alone = [d for d, t in rows if not shingles(t)]
    assert sorted(left, key=str) == sorted([*alone, *{want[r][1] for r in want if want[r][0]}], key=str)


def test_near_duplicates_of_odd_tables(spark):
    assert jaccard.near_duplicates(table(spark, [])).count() == 0
    assert jaccard.without_near_duplicates(table(spark, [])).count() == 0
    got = jaccard.near_duplicates(table(spark, ODD)).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (7, 7), (None, None)}
    left = jaccard.without_near_duplicates(table(spark, [*ODD, (2, "")])).collect()
    assert Counter(r["doc_id"] for r in left) == Counter([1, 2, 2, 3, 4, 5, None, 7])  # wordless rows are no copies


def toxic_corpus(n=900):
    rng = random.Random(5)
    bad = ["stupid", "moron", "scumbag", "loserish"]
    rows, labels = [], []
    for k in range(n):
        w = words(rng, rng.randint(20, 120)).split()
        y = int(rng.random() < 0.25)
        if y:
            for _ in range(max(2, len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", "s", "ly"])
        rows.append((k, " ".join(w)))
        labels.append((k, 1, y))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    truth = {i: y for i, _, y in labels}
    lab = spark.createDataFrame([*labels[:800], (5, 0, None), (None, 0, 1), (0, 0, labels[0][2])], "doc_id long, quality int, toxic int")
    docs = table(spark, [*rows, (2000, None), (2001, ""), (2002, "stupid moron " * 3000), (2002, "stupid moron " * 3000), (None, "no id")])
    got = toxicity.score_toxicity(docs, lab).collect()
    assert len(got) == len(rows) + 5
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r for r in got}
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    held = [i for i in truth if by[i]["held_out"] or i >= 800]
    assert np.mean([by[i]["predicted"] == truth[i] for i in held]) > 0.95
    assert by[2002]["predicted"] == 1 and by[2000]["score"] == by[2001]["score"]
    kept = toxicity.without_toxic(docs, lab)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if not r["predicted"])
    # Labels of the held-out fold change nothing.
    flipped = spark.createDataFrame([(i, q, 1 - y if by[i]["held_out"] else y) for i, q, y in labels[:800]], "doc_id long, quality int, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, flipped).collect()}
    assert all(abs(again[i] - by[i]["score"]) < 1e-12 for i in truth)


def test_toxicity_without_labels(spark):
    docs = table(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.score_toxicity(docs, none).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(k, 1, 1) for k in range(9)], "doc_id long, quality int, toxic int")
    assert [r["predicted"] for r in toxicity.score_toxicity(docs, one).collect()] == [1, 1]
    assert toxicity.score_toxicity(table(spark, []), one).count() == 0


def brute_kneser_ney(corpus, toxic, ordinary):
    """p(last symbol of a 5-gram | the four before) by class, from the definition, and the alphabet."""
    pad = lambda t: " " * 5 + re.sub(r"\s", " ", t.lower()) + " " * 5
    kinds = {3: {pad(t)[i : i + 4] for t in corpus for i in range(len(pad(t)) - 3)}}  # {order: distinct grams one longer}, of all documents
    for k in (2, 1):
        kinds[k] = {g[1:] for g in kinds[k + 1]}
    below = {k: Counter(g[1:] for g in kinds[k]) for k in (1, 2, 3)}
    alphabet = sorted(below[1])
    d = toxicity.DISCOUNT

    def level(counts, gram, lower):
        context = gram[:-1]
        own = [n for g, n in counts.items() if g[:-1] == context]
        return lower if not own else max(counts[gram] - d, 0) / sum(own) + d * len(own) / sum(own) * lower

    def shared(gram):  # the gram's last one to three symbols
        return level(below[len(gram)], gram, shared(gram[1:]) if len(gram) > 1 else 1 / len(alphabet))

    def of(texts):
        five = Counter(pad(t)[i : i + 5] for t in texts for i in range(1, len(pad(t)) - 4))
        four = Counter(g[1:] for g in five)
        three = Counter(g[1:] for g in four)
        return lambda gram: level(five, gram, level(four, gram[1:], level(three, gram[2:], toxicity.WEIGHT * shared(gram[2:]) + (1 - toxicity.WEIGHT) * shared(gram[3:]))))

    return of(toxic), of(ordinary), alphabet


def test_ratios_are_kneser_ney(spark):
    """Ratios against probabilities from the definition, which are proper; scripts other than Latin are no exception."""
    rng = random.Random(3)
    alphabets = ["ab ", "ab\n", "жя ", "你我😀", "a1 2"]
    texts = ["".join(rng.choices(a, k=rng.randint(0, 30))) for a in alphabets for _ in range(6)]
    rows = list(enumerate(texts))
    labels = [(i, i % 2) for i, _ in rows if i % 3]
    known = toxicity.label_rows(spark.createDataFrame(labels, "doc_id long, toxic int")).where("fold <> 0").collect()
    by = {r["doc_id"]: r["toxic"] for r in known}
    p, q, alphabet = brute_kneser_ney(texts, [t for i, t in rows if by.get(i) == 1], [t for i, t in rows if by.get(i) == 0])
    docs = table(spark, rows)
    own = toxicity.labelled_grams(toxicity.labelled_texts(docs, toxicity.label_rows(spark.createDataFrame(labels, "doc_id long, toxic int")).where("fold <> 0"))).toArrow()
    n = {c: sum(own[f"{c}{k}"].to_numpy() for k in toxicity.FOLDS) for c in "to"}
    wanted = spark.createDataFrame([(int(x),) for x in set(own["a"].to_pylist())], "a long")
    shared = toxicity.shared_counts(toxicity.corpus_grams(docs), wanted).toArrow()
    none = (toxicity.Lookup(np.zeros(0, np.uint64), np.zeros(0)), 0.0)
    tables = toxicity.Tables(toxicity.Grams(own["b"].to_numpy(), own["a"].to_numpy(), shared).tables(n["t"], n["o"]), none)
    for t in [*texts[::4], "ab 1ж你 zz", "xyz"]:
        s, _ = toxicity.symbols([t])
        padded = " " * 5 + re.sub(r"\s", " ", t) + " " * 5
        want = [np.log(p(g) / q(g)) for g in (padded[i : i + 5] for i in range(1, len(padded) - 4)) if g[-1] in alphabet]
        got = [r for r, c in zip(tables.ratios(s)[1:], padded[5:], strict=True) if c in alphabet]
        assert np.allclose(got, want, atol=1e-5)
    for context in ("ab a", "    ", "жя ж", "你我你我", "zzzz"):
        assert abs(sum(p(context + c) for c in alphabet) - 1) < 1e-9 and abs(sum(q(context + c) for c in alphabet) - 1) < 1e-9


def test_word_ratios_are_kneser_ney(spark):
    """Words' ratios from counts in Python; both distributions are proper over the words of all documents."""
    rng = random.Random(6)
    rows, labels = toxic_corpus(60)
    rows += [(1000, None), (1001, "ДУРАК, дурак! É é"), (1002, "馬鹿者 stupid")]
    labels += [(1001, 1, 1), (1002, 1, 0)]
    docs = table(spark, rows)
    known = toxicity.label_rows(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("fold <> 0")
    y = {r["doc_id"]: r["toxic"] for r in known.collect()}
    cut = lambda t: re.findall(r"[^\x09-\x0d\x20-/:-@\[-`{-~]+", (t or "").lower())
    holds = Counter(w for _, t in rows for w in set(cut(t)))
    count = {c: Counter(w for d, t in rows if y.get(d) == c for w in cut(t)) for c in (0, 1)}
    said = toxicity.labelled_words(toxicity.labelled_texts(docs, known)).join(toxicity.corpus_words(docs), "w").toArrow()
    n = {c: sum(said[f"{c}{k}"].to_numpy() for k in toxicity.FOLDS) for c in "to"}
    lookup = toxicity.word_ratios(said["w"].to_numpy().view(np.uint64), said["c"].to_numpy() / sum(holds.values()), n["t"], n["o"])
    tables = toxicity.Tables({}, lookup)

    def p(w, c):
        total, d = sum(count[c].values()), toxicity.DISCOUNT
        return max(count[c][w] - d, 0) / total + d * len(count[c]) / total * holds[w] / sum(holds.values())

    every = sorted(holds)
    got = tables.word_ratios(toxicity.words([" ".join(every)])[0])
    assert np.allclose(got, [np.log(p(w, 1) / p(w, 0)) for w in every], atol=1e-5) and len(every) > 200
    assert all(abs(sum(p(w, c) for w in every) - 1) < 1e-9 for c in (0, 1))
    h, first = toxicity.words(["a b", "", "ДУРАК дурак"])
    assert first.tolist() == [0, 2, 2, 4] and h[2] == h[3]


def test_toxicity_lookup():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(1, 2**63, 5000, dtype=np.uint64))
    table_ = toxicity.Lookup(keys, np.arange(len(keys)))
    asked = np.concatenate((keys[::3], rng.integers(1, 2**63, 5000, dtype=np.uint64)))
    slot, ok = table_(asked)
    assert ok.tolist() == np.isin(asked, keys).tolist()
    assert (table_.values[0][slot[ok]] == np.searchsorted(keys, asked[ok])).all()
    assert not toxicity.Lookup(np.zeros(0, np.uint64))(asked)[1].any()


def test_toxicity_in_other_scripts(spark):
    """Toxic expressions in Cyrillic, CJK and Arabic, and ones told apart by a digit."""
    rng = random.Random(8)
    for letters, bad in (("абвгдежзик", "дурак"), ("日本語文字漢書", "馬鹿者"), ("ابتثجحخد", "غبيجدا"), ("abcdefgh", "k1ll")):
        word = lambda letters=letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 4)))
        rows, labels = [], []
        for k in range(300):
            w = [word() for _ in range(40)]
            y = k % 4 == 0
            for j in range(3):
                w[rng.randrange(40)] = bad if y else (bad[:-1] if j else bad[::-1])
            rows.append((k, " ".join(w)))
            labels.append((k, int(y)))
        got = toxicity.score_toxicity(table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
        assert np.mean([r["predicted"] == dict(labels)[r["doc_id"]] for r in got]) > 0.9, bad


def test_toxicity_sample_is_bounded(spark):
    rows, labels = toxic_corpus(200)
    known = toxicity.label_rows(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("fold <> 0")
    docs = table(spark, rows)
    some = toxicity.labelled_texts(docs, known, chars=20_000).agg({"n": "sum"}).first()[0]
    assert 10_000 < some <= 20_000
    assert toxicity.labelled_texts(docs, known, most=50).count() == 50


PAGE = """<!DOCTYPE html><html><head><title>Not this</title><script>var x = "<p>no</p>";</script></head><body>
<header class="site-header"><a href="/">Site</a></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies for everything. Accept them.</p><button>OK</button></div>
<article><h1>The &eacute;vent &amp; more</h1><p>First   paragraph of the <b>story</b>&nbsp;with
a line break<br>and markup that runs on for some time.<p>Second paragraph, unclosed, also long enough to be read.<ul><li>Point one.</li><li>Point two.</li></ul></article>
<div class="ad">Buy this now. It is cheap.</div><aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">Other story</a></li></ul></aside>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I do not agree with this at all.</p></div></section>
<form class="search"><label>Search</label><input name="q"></form><footer>&copy; 2024 Site. All rights reserved.</footer></body></html>"""
MAIN = "The évent & more First paragraph of the story with a line break and markup that runs on for some time. Second paragraph, unclosed, also long enough to be read. Point one. Point two."


def test_html_blocks():
    b = html.blocks(PAGE)
    assert "Not this" in [x.text for x in b] and not any("var x" in x.text for x in b)
    assert html.blocks("") == [] and html.blocks("<p") != [] and html.blocks("<!-- <p>x</p> -->") == []
    assert [x.text for x in html.blocks("a<p>b<i>c</i>d<p>e<script>f</script>g&lt;<p")][:2] == ["a", "bcd"]
    assert [x.text for x in html.blocks("<div>a<br>b</div>c")] == ["a", "b", "c"]


def test_html_extraction(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "e", ""), (None, "n", PAGE), (5, "l", PAGE.replace("<p>Second", "<p>More text here for all to read.</p>" * 3000 + "<p>Second"))]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html.extract_pages(df)
    assert got.columns == ["page_id", "url", "text"]
    by = defaultdict(list)
    for r in got.collect():
        by[r["page_id"]].append(r["text"])
    assert by[1] == [MAIN, MAIN] and by[None] == [MAIN] and by[2] == by[3] == [""]
    assert len(by[5][0]) == len(MAIN) + 3000 * 32
    assert html.extract_pages(df.limit(0)).count() == 0


def test_html_labeller_on_unseen_pages():
    net, rng = html.Labeller(html.trained()), random.Random(4242)
    right = n = 0
    for page, y in (html.make_page(rng) for _ in range(150)):
        if len(page):
            z = net.logits(*html.padded([html.vectors(page)]))[0] > 0
            right, n = right + int((z == (y > 0)).sum()), n + len(y)
    assert right / n > 0.985


def test_html_gradients():
    rng = np.random.default_rng(1)
    net = html.Labeller.fresh(rng)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, mask = rng.standard_normal((2, 4, html.WIDTH)), np.array([[1, 1, 1, 1], [1, 1, 0, 0.0]])
    y = (rng.random((2, 4)) < 0.5) * 1.0

    def loss():
        z = net.logits(x, mask)
        return float(((np.log1p(np.exp(z)) - y * z) * mask).sum() / mask.sum())

    g = net.gradients(x, mask, y)
    for k in net.w:
        i = tuple(int(rng.integers(n)) for n in net.w[k].shape)
        old = net.w[k][i]
        net.w[k][i] = old + 1e-3
        up = loss()
        net.w[k][i] = old - 1e-3
        down = loss()
        net.w[k][i] = old
        assert abs((up - down) / 2e-3 - g[k][i]) < 1e-3


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    rows, labels = toxic_corpus(300)
    item = words(rng, 30)
    rows += [(5000, words(rng, 60) + " " + item), (5001, rows[0][1]), (5002, edited(rng, rows[0][1], 1)), (5003, None)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    toxic = {i for i, _, y in labels if y}
    assert len(toxic - seen["toxicity"]) > 0.9 * len(toxic) and len({i for i, _, y in labels if not y} & seen["toxicity"]) > 0.95 * (300 - len(toxic))
    assert seen["line_dedup"] == seen["toxicity"]
    assert not {5001, 5002} & seen["near_duplicates"] or 0 not in seen["toxicity"]
    assert 5000 in seen["near_duplicates"] and seen["decontamination"] == seen["near_duplicates"] - {5000} and seen["packing"] == seen["decontamination"]
    assert pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_pipeline_stages_of_odd_tables(spark, tmp_path):
    """Empty tables, nulls everywhere, rows that repeat, extra columns with names of the operators' own."""
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, rk string, th string, keep string, drops string, sig string, `two words` string, `a.b` string, `c``d.e` string"
    same = "a text that stands here three times and has enough words"
    rows = [(None, None), (1, None), (2, ""), (2, ""), (3, " \n "), (4, same), (4, same), (5, same), (None, same), (6, "only this one\nand a second line"), (7, "long " * 60_000)]
    docs = spark.createDataFrame([(d, t, None, None, None if t is None else len(t), "r", None, "k", "d", "s", "w", "x", None) for d, t in rows], schema)
    for has_labels in (False, True):
        path = str(tmp_path / str(has_labels))
        spark.createDataFrame([(k, 1, k % 2) for k in range(8)] if has_labels else [], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame([(None, None), (1, ""), (2, "none of these words")] if has_labels else [], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        for name, stage in pipeline.STAGES:
            assert stage(spark, docs.limit(0), path).count() == 0
            out = stage(spark, docs, path)
            got = Counter((r["doc_id"], r["text"]) if name != "packing" else r["doc_id"] for r in out.collect())
            if name != "packing":
                assert out.columns == docs.columns and out.dtypes == docs.dtypes
            if name == "near_duplicates":
                assert got == Counter(dict.fromkeys([r for r in rows if r[1] != same], 1)) + Counter({(2, ""): 1, (4, same): 1})
            elif name == "packing":
                assert got.keys() == {d for d, _ in rows} and got[7] > 50
            elif name != "toxicity" or not has_labels:
                assert got == Counter(rows), name


def test_a_sample_of_labelled_texts_is_never_empty(spark):
    rows, labels = toxic_corpus(60)
    docs = table(spark, rows)
    known = toxicity.label_rows(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("fold <> 0")
    whole = toxicity.labelled_texts(docs, known).count()
    assert toxicity.labelled_texts(docs, known, chars=1).count() == 1 and 1 < toxicity.labelled_texts(docs, known, chars=3000).count() < whole


def test_nothing_else_imports_this_package():
    from pathlib import Path

    root = Path(jaccard.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", p.read_text(), re.M), p
