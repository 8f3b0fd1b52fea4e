"""HTML extraction: a recurrent block labeller.

A page becomes its sequence of leaf blocks (runs of text between block-level tags, entities decoded). Each block is a
vector: a hashed bag of its tag path (tags, classes and ids of all open elements), a hashed bag of its words, and its
length, link share and place. A bidirectional LSTM in numpy reads the whole sequence, so each block is classed by what
stands anywhere on the page, and the blocks classed as main text are joined in page order.

The network is trained here, on first use in a process, from generated pages with known labels (make_page): many layouts
of menus, headers, sidebars, notices, adverts, forms and comments around articles of invented words. No page of the
data is used. Seeds are fixed, so every process gets the same weights; the driver trains and broadcasts them (0.3 MB).

Defined results: null or empty html gives the empty text; a page without main blocks too; broken markup is read as far
as it goes (an unclosed tag ends with its parent); repeated rows are done each; a null page_id is kept; an empty table
gives no rows; other columns are ignored. Nothing is capped: a long page is a long sequence.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

PATH, WORD, PLAIN = 128, 32, 7
WIDTH, HIDDEN = PATH + WORD + PLAIN, 24
PAGES, EPOCHS, BATCH, RATE, SEED = 2000, 7, 32, 4e-3, 11

# Elements that do not part blocks, that hold no text, that have no end tag.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_SILENT = frozenset("script style noscript template svg iframe object".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# A start tag on the left closes an open element on the right, if that is the nearest of its kind.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_NAME_OF = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_MARK = re.compile(r"[>\"']")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")


class Element:
    """An open element: its names (tag, classes, ids), what it stands in, and the nearest element around or of itself that
    parts blocks. Blocks share their elements, so a page's paths take no more room than its tags."""

    __slots__ = ("above", "block", "key", "names", "tag", "vector")

    def __init__(self, tag: str, names: tuple[str, ...], above: Element | None):
        self.tag, self.names, self.above, self.vector = tag, names, above, None
        self.block = self if tag not in _INLINE else above.block if above else None
        self.key = hash((above.key if above else 0, names))


class Block:
    __slots__ = ("element", "linked", "text")

    def __init__(self, element: Element | None, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked


class _Tags:
    """Finds the tags of a page in one pass: quotes in a tag are heeded as long as they close; from the first tag on that
    never ends that way, a tag ends at the first >."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def end(self, at: int) -> int:
        """The place of the > of the tag that begins at `at`, or -1."""
        if self.quotes:
            i = at
            while m := _MARK.search(self.page, i):
                if m[0] == ">":
                    return m.start()
                i = self.page.find(m[0], m.end()) + 1
                if not i:
                    break
            self.quotes = False
        return self.page.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, bool, str]:
        """(start, end, name, whether it closes, attributes) of the next tag; a comment or declaration has no name; at the
        end of the page both places are its length."""
        page = self.page
        while (i := page.find("<", at)) >= 0:
            if page.startswith("<!--", i):
                j = page.find("-->", i + 4)
                return i, j + 3 if j >= 0 else len(page), "", False, ""
            if page.startswith(("<!", "<?"), i):
                j = page.find(">", i)
            elif m := _NAME_OF.match(page, i):
                j = self.end(m.end())
                if j >= 0:
                    return i, j + 1, m[1].lower(), page[i + 1] == "/", page[m.end() : j]
            else:
                at = i + 1
                continue
            if j < 0:  # nothing closes a tag any more
                break
            return i, j + 1, "", False, ""
        return len(page), len(page), "", False, ""


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order; blank ones are left out. One pass, in time and room of the page's length."""
    out: list[Block] = []
    stack: list[Element] = []
    open_: Counter[str] = Counter()  # tags on the stack
    run: list[Counter[str]] = [Counter()]  # inline ones since the last block, by block
    parts: list[str] = []
    state = {"linked": 0, "at": None, "solid": False}

    def flush():
        if state["solid"]:
            out.append(Block(state["at"], " ".join("".join(parts).split()), state["linked"]))
        parts.clear()
        state["linked"], state["solid"] = 0, False

    def add(raw: str):
        text = html.unescape(raw) if "&" in raw else raw
        if not state["solid"]:
            state["at"] = stack[-1] if stack else None
        bare = text.strip()
        state["solid"] = state["solid"] or bool(bare)
        parts.append(text)
        if open_["a"]:
            state["linked"] += len(bare)

    def pop_to(last: Element):
        while True:
            e = stack.pop()
            open_[e.tag] -= 1
            if e.tag in _INLINE:
                run[-1][e.tag] -= 1
            else:
                run.pop()
            if e is last:
                return

    def pop(name: str):
        """Closes the nearest element of the name."""
        while stack[-1].tag != name:
            pop_to(stack[-1])
        pop_to(stack[-1])

    tags, at, n = _Tags(page), 0, len(page)
    while at < n:
        start, end, name, closes, attributes = tags.next(at)
        if start > at:
            add(page[at:start])
        at = end
        if not name:
            continue
        inline = name in _INLINE
        if closes:
            if not inline:
                flush()
            if (run[-1] if inline else open_)[name]:  # an inline end tag closes nothing outside its block
                pop(name)
            continue
        if name in _SILENT:
            if not attributes.rstrip().endswith("/"):
                over = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = over.end() if over else n
            continue
        if not inline:
            flush()
            # A block ends an open paragraph, and unclosed inline tags in it.
            if name not in _VOID and stack and (nearest := stack[-1].block) and (nearest.tag == "p" or nearest.tag in _CLOSES.get(name, ())):
                pop_to(nearest)
        if name in _VOID:
            continue
        names = [name]
        for a in _ATTR.finditer(attributes):
            names += [f"{a[1][0].lower()}.{w}" for w in _NAME.findall((a[2] or a[3] or a[4] or "").lower())]
        stack.append(Element(name, tuple(names), stack[-1] if stack else None))
        open_[name] += 1
        if inline:
            run[-1][name] += 1
        else:
            run.append(Counter())
    flush()
    return out


@lru_cache(maxsize=1 << 16)
def _hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


_known: dict[int, np.ndarray] = {}
KNOWN = 1 << 14


def _add(v: np.ndarray, word: str) -> None:
    h = _hash(word)
    v[h % PATH] += 1 if h >> 16 & 1 else -1


def _path_sum(e: Element) -> np.ndarray:
    """The hashed names of an element and all around it, each added from the one outside."""
    chain = []
    while e is not None and e.vector is None:
        e.vector = _known.get(e.key)
        if e.vector is None:
            chain.append(e)
            e = e.above
    v = e.vector if e is not None else np.zeros(PATH, np.int32)
    for e in reversed(chain):
        v = v.copy()
        for name in e.names:
            _add(v, "p " + name)
        e.vector = v
        if len(_known) >= KNOWN:
            _known.clear()
        _known[e.key] = v
    return v


def _path_vector(e: Element | None) -> np.ndarray:
    if e is None:
        return np.zeros(PATH, np.float32)
    v = _path_sum(e).copy()
    _add(v, "leaf " + e.names[-1])
    return np.clip(v, -2, 2)


def vectors(page: list[Block]) -> np.ndarray:
    x = np.zeros((len(page), WIDTH), np.float32)
    for k, b in enumerate(page):
        x[k, :PATH] = _path_vector(b.element)
        words = b.text.lower().split()
        for w in set(words):
            h = _hash(w)
            x[k, PATH + h % WORD] += 1.0 if h >> 16 & 1 else -1.0
        x[k, PATH : PATH + WORD] /= max(1.0, len(words) ** 0.5)
        n = len(b.text)
        x[k, PATH + WORD :] = (np.log1p(n) / 6, b.linked / max(1, n), len(words) < 8, b.text[-1] in ".!?…\"”", k / len(page), (len(page) - 1 - k) / len(page), "©" in b.text)
    return x


class Labeller:
    """A bidirectional LSTM and a logistic output over padded batches (batch, time, width)."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @staticmethod
    def fresh(rng: np.random.Generator) -> Labeller:
        w = {}
        for d in "fb":
            w[f"x{d}"] = (rng.standard_normal((WIDTH, 4 * HIDDEN)) * WIDTH**-0.5).astype(np.float32)
            w[f"h{d}"] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) * HIDDEN**-0.5).astype(np.float32)
            w[f"c{d}"] = np.zeros(4 * HIDDEN, np.float32)
            w[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1
        w["o"] = (rng.standard_normal((2 * HIDDEN + WIDTH, 1)) * 0.1).astype(np.float32)
        w["b"] = np.zeros(1, np.float32)
        return Labeller(w)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        n, t, _ = x.shape
        z = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, saved = np.zeros((n, t, HIDDEN), np.float32), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            g = z[:, k] + h @ self.w[f"h{d}"]
            s = 1 / (1 + np.exp(-np.clip(g[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            u = np.tanh(g[:, 3 * HIDDEN :])
            m = mask[:, k, None]
            c1 = f * c + i * u
            th = np.tanh(c1)
            if keep:
                saved.append((k, h, c, i, f, o, u, th, m))
            h = m * (o * th) + (1 - m) * h
            c = m * c1 + (1 - m) * c
            out[:, k] = h
        return out, saved

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        f, b = self._run(x, mask, "f", False)[0], self._run(x, mask, "b", False)[0]
        return (np.concatenate((f, b, x), 2) @ self.w["o"])[:, :, 0] + self.w["b"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate((runs["f"][0], runs["b"][0], x), 2)
        p = 1 / (1 + np.exp(-np.clip((both @ self.w["o"])[:, :, 0] + self.w["b"], -30, 30)))
        dl = ((p - y) * mask / mask.sum()).astype(np.float32)[:, :, None]
        g = {"o": np.einsum("ntk,nto->ko", both, dl), "b": dl.sum((0, 1))}
        dh_all = dl @ self.w["o"][: 2 * HIDDEN].T
        for d, part in (("f", dh_all[:, :, :HIDDEN]), ("b", dh_all[:, :, HIDDEN:])):
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            gh = np.zeros_like(self.w[f"h{d}"])
            dh, dc = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
            for k, h0, c0, i, f, o, u, th, m in reversed(runs[d][1]):
                dh = dh + part[:, k]
                own, rest = m * dh, (1 - m) * dh
                dc1 = m * dc + own * o * (1 - th * th)
                q = np.concatenate((dc1 * u * i * (1 - i), dc1 * c0 * f * (1 - f), own * th * o * (1 - o), dc1 * i * (1 - u * u)), 1)
                dz[:, k] = q
                gh += h0.T @ q
                dh = rest + q @ self.w[f"h{d}"].T
                dc = (1 - m) * dc + dc1 * f
            g[f"x{d}"] = np.einsum("ntw,ntg->wg", x, dz, optimize=True)
            g[f"h{d}"] = gh
            g[f"c{d}"] = dz.sum((0, 1))
        return g


def padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, seqs))
    x, mask = np.zeros((len(seqs), t, seqs[0].shape[1]), np.float32), np.zeros((len(seqs), t), np.float32)
    for k, s in enumerate(seqs):
        x[k, : len(s)] = s
        mask[k, : len(s)] = 1
    return x, mask


# --- generated pages -------------------------------------------------------------------------------------------------

_BOILER = "home about contact login search subscribe newsletter cookies privacy policy terms accept share tweet follow menu next previous advertisement sponsored related comments reply copyright rights reserved sign up read more tags archive categories".split()


class _Maker:
    """Writes a page and, beside it, whether each leaf block is main text: main blocks start with the mark \\x01."""

    def __init__(self, rng: random.Random):
        self.r = rng
        self.syllables = ["".join(rng.choices("abcdefghijklmnoprstuvwyäéñöüßç", k=rng.randrange(1, 4))) for _ in range(60)]

    def one(self, *options):
        return options[int(self.r.random() * len(options))]

    def chance(self, p):
        return self.r.random() < p

    def words(self, lo, hi):
        return " ".join("".join(self.r.choices(self.syllables, k=self.r.randrange(1, 5))) for _ in range(self.r.randrange(lo, hi)))

    def prose(self, lo=5, hi=90):
        text = ". ".join(self.words(2, 16).capitalize() for _ in range(max(1, self.r.randrange(lo, hi) // 9)))
        return text + self.one(".", ".", ".", "!", "?", "")

    def phrase(self):
        return " ".join(self.one(*_BOILER) for _ in range(self.r.randrange(1, 4))) if self.chance(0.5) else self.words(1, 4)

    def cls(self, *names):
        if self.chance(0.2):
            return ""
        name = self.one(*names) + (self.one("", "", "-wrapper", "-inner", " clearfix", "-box", " col"))
        return f' {self.one("class", "class", "id")}="{name}"'

    def links(self, n, main=False):
        mark = "\x01" if main else ""
        return "<ul>" + "".join(f'<li><a href="/{k}">{mark}{self.phrase()}</a>' + self.one("</li>", "</li>", "") for k in range(n)) + "</ul>"

    def nav(self):
        body = self.links(self.r.randrange(2, 12)) if self.chance(0.7) else " | ".join(f'<a href="#">{self.phrase()}</a>' for _ in range(self.r.randrange(2, 8)))
        return f"<nav{self.cls('nav', 'main')}>{body}</nav>" if self.chance(0.6) else f"<div{self.cls('menu', 'nav', 'navbar', 'navigation', 'breadcrumb', 'topbar')}>{body}</div>"

    def header(self):
        inner = self.one(f"<h1>{self.words(1, 6)}</h1>", f"<a href='/'>{self.words(1, 4)}</a>", f"<p>{self.words(2, 9)}</p>") + (self.nav() if self.chance(0.4) else "")
        return f"<header{self.cls('header', 'site', 'masthead')}>{inner}</header>" if self.chance(0.6) else f'<div class="{self.one("header", "masthead", "site-header", "banner")}">{inner}</div>'

    def footer(self):
        inner = self.one(f"&copy; {self.words(1, 4)} &middot; {self.prose(3, 40)}", f"<p>&copy; 20{self.r.randrange(10, 30)} {self.words(1, 4)}</p>" + self.links(3), self.prose(3, 30), f"<p>{self.prose(5, 40)}</p><p>{self.phrase()}</p>")
        return f"<footer{self.cls('footer', 'site')}>{inner}" + self.one("</footer>", "</footer>", "") if self.chance(0.7) else f'<div class="{self.one("footer", "site-footer", "bottom", "copyright")}">{inner}</div>'

    def advert(self):
        return f'<{(t := self.one("div", "div", "aside", "section", "p"))} {self.one("class", "id")}="{self.one("ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner-ad", "advertisement")}">{self.one(self.prose(3, 50), f"<a href=x>{self.prose(3, 20)}</a>", f"<p>{self.prose(3, 50)}</p>", self.words(1, 8))}</{t}>'

    def notice(self):
        return f'<div {self.one("class", "id")}="{self.one("cookie", "cookie-notice", "consent", "notice", "gdpr", "alert", "popup", "modal", "newsletter")}"><p>{self.one("We use cookies", "Cookies", self.words(2, 6))} {self.prose(3, 40)}</p>' + self.one("<button>Accept</button>", "<a href=#>OK</a>", "") + "</div>"

    def form(self):
        return f"<form{self.cls('search', 'login', 'subscribe', 'contact')}><label>{self.phrase()}</label><input name=q>{self.one('', f'<p>{self.prose(3, 25)}</p>')}<button>{self.phrase()}</button></form>"

    def sidebar(self):
        inner = "".join(self.one(lambda: f"<h3>{self.words(1, 4)}</h3>" + self.links(self.r.randrange(2, 8)), lambda: f"<p>{self.prose(5, 45)}</p>", self.advert, lambda: f"<div class=widget>{self.prose(4, 30)}</div>")() for _ in range(self.r.randrange(1, 4)))
        return f"<aside{self.cls('sidebar', 'related')}>{inner}</aside>" if self.chance(0.6) else f'<div class="{self.one("sidebar", "side", "widget-area", "related", "rail")}">{inner}</div>'

    def comments(self):
        item = lambda t: f'<{t} class="{self.one("comment", "comment-body", "reply")}">' + self.one(f"<p><b>{self.words(1, 3)}</b></p>", f"<span class=author>{self.words(1, 3)}</span>", f"<cite>{self.words(1, 2)}</cite>", "") + f"<p>{self.prose(3, 60)}</p></{t}>"
        t = self.one("div", "li", "article", "div")
        return f'<{(o := self.one("section", "div", "ol"))} {self.one("class", "id")}="{self.one("comments", "comment-list", "responses", "discussion")}">' + self.one("<h2>Comments</h2>", f"<h3>{self.words(1, 3)}</h3>", "") + "".join(item(t) for _ in range(self.r.randrange(1, 6))) + (self.form() if self.chance(0.3) else "") + f"</{o}>"

    def article(self):
        m = "\x01"

        def para():
            text = self.prose()
            if self.chance(0.15):
                text = text.replace(" ", " <a href=/x>", 1).replace(".", "</a>.", 1)
            return self.one(f"<p>{m}{text}</p>", f"<p>{m}{text}</p>", f"<p>{m}{text}", f"<p><b>{m}{text}<br>", f"<p>{m}<b>{text}</b></p>", f"<p>{m}{text}<br>{m}{self.prose()}</p>", f"<p>{m}{self.words(1, 3)}.</p>", f"<div>{m}{text}</div>")

        kinds = [para] * 12 + [
            lambda: f"<h2>{m}{self.words(1, 8)}</h2>", lambda: f"<h3>{m}{self.words(1, 6)}</h3>", lambda: f"<{(t := self.one('ul', 'ol'))}>" + "".join(f"<li>{m}{self.prose(2, 20)}</li>" for _ in range(self.r.randrange(1, 6))) + f"</{t}>",
            lambda: f"<blockquote>{self.one('<p>', '')}{m}{self.prose(4, 40)}</blockquote>", lambda: f"<pre>{m}{self.words(3, 20)}</pre>", lambda: f"<figure><img src=x><figcaption>{m}{self.words(2, 12)}</figcaption></figure>",
            lambda: "<table>" + "".join(f"<tr><td>{m}{self.words(1, 4)}</td><td>{m}{self.words(1, 4)}</td></tr>" for _ in range(self.r.randrange(1, 4))) + "</table>",
        ]
        body = [self.one(*kinds)() for _ in range(self.r.randrange(1, 16))]
        if self.chance(0.25):
            body.insert(self.r.randrange(len(body) + 1), self.one(self.advert, self.advert, self.form, self.notice, self.sidebar)())
        head = self.one(f"<h1>{m}{self.words(2, 12)}</h1>", f"<h1>{m}{self.words(2, 12)}</h1>", f"<h2>{m}{self.words(2, 12)}</h2>", "")
        inner = head + "".join(body)
        name = self.one("content", "post", "entry", "article", "article-body", "story", "post-content", "main-content", "text")
        return self.one(
            f"<article>{inner}</article>", f"<article>{inner}</article>", f"<article>{inner}</article>", f'<article class="{name}">{inner}</article>', f"<main>{inner}</main>", f"<main><article>{inner}</article></main>",
            f'<div class="{name}">{inner}</div>', f'<div id="{name}">{inner}</div>', f'<section class="{name}">{inner}</section>', f'<div class="wrap"><div class="{name}">{inner}</div></div>', inner,
        )

    def page(self):
        before = [self.one(self.nav, self.header, self.nav, self.advert, self.notice, self.form)() for _ in range(self.r.randrange(0, 5))]
        after = [self.one(self.sidebar, self.advert, self.comments, self.comments, self.form, self.notice, self.nav)() for _ in range(self.r.randrange(0, 4))] + ([self.footer()] if self.chance(0.85) else [])
        title = f"<title>{self.words(2, 12)}</title>"
        return f"<!DOCTYPE html><html><head>{title}<style>p{{}}</style></head><body>" + "".join(before) + self.article() + "".join(after) + self.one("</body></html>", "")


def make_page(rng: random.Random) -> tuple[list[Block], np.ndarray]:
    """(blocks, labels) of a generated page."""
    page = blocks(_Maker(rng).page())
    y = np.array(["\x01" in b.text for b in page], np.float32)
    for b in page:
        b.text = b.text.replace("\x01", "") or "-"
    return page, y


@lru_cache(maxsize=1)
def trained() -> dict[str, np.ndarray]:
    """The weights, by Adam over PAGES generated pages."""
    rng = np.random.default_rng(SEED)
    maker = random.Random(SEED)
    data = [(vectors(p), y) for p, y in (make_page(maker) for _ in range(PAGES)) if len(p)]
    net = Labeller.fresh(rng)
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        by = sorted(rng.permutation(len(data)).tolist(), key=lambda i: len(data[i][0]) + rng.random() * 6)
        starts = list(range(0, len(by), BATCH))
        rng.shuffle(starts)
        for s in starts:
            own = [data[i] for i in by[s : s + BATCH]]
            x, mask = padded([v for v, _ in own])
            y = padded([y[:, None] for _, y in own])[0][:, :, 0]
            step += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for k, g in net.gradients(x, mask, y).items():
                g = np.clip(g, -0.5, 0.5)
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.01 * (g * g - m2[k])
                net.w[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net.w


def main_texts(pages: list[str], net: Labeller, group: int = 64) -> list[str]:
    """The main text of each page; pages of like length are labelled together."""
    read = [blocks(p) for p in pages]
    out = [""] * len(pages)
    by = sorted((k for k in range(len(read)) if read[k]), key=lambda k: len(read[k]))
    at = 0
    while at < len(by):
        n = max(1, min(group, 20_000 // len(read[by[min(at + group, len(by)) - 1]])))
        own = by[at : at + n]
        at += n
        x, mask = padded([vectors(read[k]) for k in own])
        for k, row in zip(own, net.logits(x, mask), strict=True):
            out[k] = " ".join(b.text for b, v in zip(read[k], row, strict=False) if v > 0)
    return out


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    weights = pages.sparkSession.sparkContext.broadcast(trained())
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def work(batches):
        net = Labeller(weights.value)
        for batch in slices(batches):
            got = main_texts(batch.column("html").to_pylist(), net)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(got, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(work, "page_id long, url string, text string")
