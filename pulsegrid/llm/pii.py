"""Personal data: base rules, and a character-level bidirectional LSTM with CRF transitions.

The base rules find addresses of mail and hosts, card numbers that pass Luhn's check and international telephone numbers.
The network reads characters and tags what the rules cannot spell out: hidden, spaced or accented mail addresses, other forms of
host addresses, cards with odd separators, national telephone numbers, account numbers (IBAN) and social-security numbers.
It is trained here, in numpy, from generated texts whose spans are labelled by their making (example), by the likelihood of
whole tag sequences; no text of the data is used. Seeds are fixed; the driver trains once a process and broadcasts the weights.

A text is cut into blocks of OWN characters. A window is a block and MARGIN characters on each side, so windows overlap; each is
decoded by Viterbi's method, a character takes its tag from the window whose block holds it, and spans are read from the tags
of the whole text, across blocks. A span holds a digit, an @ or a bracketed "at" or "dot" by definition, so only blocks with
such a sign in them or in a neighbour are decoded: further ones cannot hold a part of a span of fewer than OWN characters to
its sign (`everywhere=True` decodes all; the tests hold both against each other). What the tags say is then checked exactly: Luhn
for cards, remainder 97 for accounts, parts for hosts, 9 to 15 digits for telephones. Kinds that the rules know are left out
where a base span overlaps them.

Defined results: null text is empty and has no spans; repeated rows are read each; a null doc_id is kept; an empty table
gives no rows; other columns are ignored. Memory: one Arrow batch; time grows with the text's length, whatever it holds.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, text_rows

# The base rules.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # [0-9]+(\.[0-9]+){3}: a match takes whole runs of digits
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
#: What the network tags; the first ones are the rules' kinds.
TAGGED = (*KINDS, "iban", "ssn")
ALL_KINDS = (*KINDS, *(f"model_{k}" for k in TAGGED))

_SIGN = re.compile(r"[0-9@]|[\[({<]\x20?(?:at|AT|dot|DOT)\x20?[\])}>]")
OWN, MARGIN = 64, 48
WIDTH = OWN + 2 * MARGIN
HIDDEN, SYMBOLS, TAGS = 24, 134, 1 + 2 * len(TAGGED)  # tag 0 is outside, 2k + 1 begins kind k, 2k + 2 continues it
TEXTS, EPOCHS, BATCH, LENGTH, RATE, SEED = 9600, 5, 48, 96, 8e-3, 5
LOT = 256  # windows decoded at once


# --- base rules ------------------------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if k & 1 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches by the @ in them: each begins at the first of the characters that may stand before it."""
    over, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > over and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            over = m.end()
        else:
            over = at + 1
        at = text.find("@", over)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = [(s, 0, e) for s, e in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# --- the network -----------------------------------------------------------------------------------------------------


def symbols(text: str) -> np.ndarray:
    """A symbol for each code point: 1 + ASCII; 129 letters that have case, 130 other letters, 131 digits, 132 spaces, 133
    others; 0 is beyond the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.minimum(points, 127).astype(np.uint8) + np.uint8(1)
    for k in np.flatnonzero(points > 127):
        out[k] = _other(text[k])
    return out


@lru_cache(maxsize=1 << 14)
def _other(c: str) -> int:
    return 129 if c.lower() != c.upper() else 130 if c.isalpha() else 131 if c.isdigit() else 132 if c.isspace() else 133


def _allowed() -> np.ndarray:
    """Costs of transitions that no tagging has: a kind continues only itself."""
    out = np.zeros((TAGS, TAGS), np.float32)
    for j in range(2, TAGS, 2):
        out[[i for i in range(TAGS) if i not in (j - 1, j)], j] = -1e4
    return out


class Tagger:
    """Weights and what is computed with them. Arrays are (time, batch, ..)."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @staticmethod
    def fresh(rng: np.random.Generator) -> Tagger:
        normal = lambda *shape: rng.standard_normal(shape).astype(np.float32)
        w = {"x": normal(2, SYMBOLS, 4 * HIDDEN) * np.float32(0.3), "h": normal(2, HIDDEN, 4 * HIDDEN) * np.float32(HIDDEN**-0.5), "o": normal(2 * HIDDEN, TAGS) * np.float32(0.2)}
        w["x"][:, :, HIDDEN : 2 * HIDDEN] += 1  # remember at first
        w["c"], w["s"], w["t"] = np.zeros(TAGS, np.float32), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32)
        return Tagger(w)

    def _run(self, codes: np.ndarray, keep: bool):
        """States of both directions (time, direction, batch, HIDDEN); the second one reads from the end."""
        (n, m), x, wh = codes.shape, self.w["x"], self.w["h"]
        h, c = np.zeros((2, m, HIDDEN), np.float32), np.zeros((2, m, HIDDEN), np.float32)
        out, saved, g = np.empty((n, 2, m, HIDDEN), np.float32), [], np.empty((2, m, 4 * HIDDEN), np.float32)
        for k in range(n):
            np.matmul(h, wh, out=g)
            g[0] += x[0][codes[k]]
            g[1] += x[1][codes[n - 1 - k]]
            s = 1 / (1 + np.exp(-g[:, :, : 3 * HIDDEN]))
            i, f, o = s[:, :, :HIDDEN], s[:, :, HIDDEN : 2 * HIDDEN], s[:, :, 2 * HIDDEN :]
            u = np.tanh(g[:, :, 3 * HIDDEN :])
            c1 = f * c + i * u
            th = np.tanh(c1)
            if keep:
                saved.append((h, c, i, f, o, u, th))
            h, c = o * th, c1
            out[k] = h
        return np.concatenate((out[:, 0], out[::-1, 1]), 2), saved

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        return self._run(codes, False)[0] @ self.w["o"] + self.w["c"]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The likeliest tags (time, batch)."""
        e, trans = self.emissions(codes), self.w["t"] + _allowed()
        n, m, _ = e.shape
        via, best = np.empty((n, m, TAGS), np.uint8), self.w["s"] + e[0]
        for k in range(1, n):
            each = best[:, :, None] + trans
            via[k] = each.argmax(1)
            best = each.max(1) + e[k]
        out = np.empty((n, m), np.uint8)
        out[-1] = best.argmax(1)
        for k in range(n - 1, 0, -1):
            out[k - 1] = via[k][np.arange(m), out[k]]
        return out

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(mean negative log-likelihood of the taggings, its gradients)."""
        both, saved = self._run(codes, True)
        e, trans = both @ self.w["o"] + self.w["c"], self.w["t"] + _allowed()
        n, m, _ = e.shape
        step, rows = np.exp(trans), np.arange(m)
        a, b = np.empty_like(e), np.empty_like(e)
        a[0], b[-1] = self.w["s"] + e[0], 0
        for k in range(1, n):
            top = a[k - 1].max(1, keepdims=True)
            a[k] = np.log(np.exp(a[k - 1] - top) @ step + 1e-30) + top + e[k]
        for k in range(n - 1, 0, -1):
            v = b[k] + e[k]
            top = v.max(1, keepdims=True)
            b[k - 1] = np.log(np.exp(v - top) @ step.T + 1e-30) + top
        whole = np.logaddexp.reduce(a[-1], 1)
        told = self.w["s"][tags[0]] + e[np.arange(n)[:, None], rows, tags].sum(0) + trans[tags[:-1], tags[1:]].sum(0)
        de = np.exp(a + b - whole[:, None])
        own = np.zeros_like(trans)
        for k in range(1, n):
            top = a[k - 1].max(1, keepdims=True)
            own += np.exp(a[k - 1] - top).T @ np.exp(e[k] + b[k] + top - whole[:, None])
        dt = own * step
        np.add.at(dt, (tags[:-1].ravel(), tags[1:].ravel()), -1)
        de[np.arange(n)[:, None], rows, tags] -= 1
        de /= m
        g = {"t": dt / m, "s": de[0].sum(0), "c": de.sum((0, 1)), "o": both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS)}
        part = de @ self.w["o"].T
        part = np.stack((part[:, :, :HIDDEN], part[::-1, :, HIDDEN:]), 1)
        dz, wt = np.empty((n, 2, m, 4 * HIDDEN), np.float32), self.w["h"].transpose(0, 2, 1)
        dh, dc, g["h"] = np.zeros((2, m, HIDDEN), np.float32), np.zeros((2, m, HIDDEN), np.float32), np.zeros_like(self.w["h"])
        for k in range(n - 1, -1, -1):
            h0, c0, i, f, o, u, th = saved[k]
            dh = dh + part[k]
            dc = dc + dh * o * (1 - th * th)
            q = dz[k]
            q[:, :, :HIDDEN], q[:, :, HIDDEN : 2 * HIDDEN], q[:, :, 2 * HIDDEN : 3 * HIDDEN], q[:, :, 3 * HIDDEN :] = dc * u * i * (1 - i), dc * c0 * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - u * u)
            g["h"] += h0.transpose(0, 2, 1) @ q
            dh, dc = q @ wt, dc * f
        g["x"] = np.zeros_like(self.w["x"])
        for d, flat in enumerate((codes.ravel(), codes[::-1].ravel())):
            by = np.argsort(flat, kind="stable")
            first = np.flatnonzero(np.diff(flat[by], prepend=-1))
            g["x"][d, flat[by][first]] = np.add.reduceat(dz[:, d].reshape(-1, 4 * HIDDEN)[by], first)
        return float((whole - told).mean()), g


# --- labelled texts --------------------------------------------------------------------------------------------------


class Maker:
    """Writes texts and the spans in them."""

    def __init__(self, rng: random.Random):
        self.r = rng

    def one(self, *options):
        return options[int(self.r.random() * len(options))]

    def digits(self, n: int) -> str:
        return "".join(self.r.choices("0123456789", k=n))

    def letters(self, lo: int, hi: int, alphabet: str = "abcdefghijklmnopqrstuvwxyzaeiourstn") -> str:
        return "".join(self.r.choices(alphabet, k=self.r.randint(lo, hi)))

    def word(self) -> str:
        alphabet = self.one("abcdefghijklmnopqrstuvwxyzaeiourstn", "abcdefghijklmnopqrstuvwxyzaeiourstn", "abdefghiklmnoprstuzäöüßeenr", "aeiouéèêçàlmnrstdpqv", "абвгдежзиклмнопрстуя", "的一是不了人我在有他这")
        w = self.letters(1, 10, alphabet)
        return self.one(w, w, w, w.capitalize(), w.upper()) + self.one("", "", "", "", ",", ".", ":", ";", "!", ")")

    def grouped(self, text: str, by: int, mark: str) -> str:
        return mark.join(text[i : i + by] for i in range(0, len(text), by))

    def decoy(self) -> str:
        d, r = self.digits, self.r
        return self.one(
            d(r.randint(1, 8)), d(r.randint(9, 11)), f"{r.randint(1900, 2099)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28)}.{r.randint(1, 12):02}.{r.randint(1900, 2099)}", f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1900, 2099)}",
            f"{r.randint(0, 23):02}:{d(2)}:{d(2)}", f"{r.randint(0, 23)}:{d(2)}", f"{d(r.randint(1, 4))}.{d(2)}", self.grouped(d(r.choice((6, 9, 12))), 3, ","), self.grouped(d(r.choice((6, 9))), 3, "."), ".".join(str(r.randint(0, 30)) for _ in range(r.choice((2, 3)))),
            "".join(r.choices("0123456789abcdef", k=r.choice((24, 32, 40, 64)))), "-".join("".join(r.choices("0123456789abcdef", k=k)) for k in (8, 4, 4, 4, 12)), "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=r.randint(8, 40))),
            f"{r.randint(1900, 2020)}-{r.randint(1900, 2099)}", f"{self.letters(1, 3).upper()}-{d(r.randint(2, 6))}", f"{self.letters(2, 6)}{d(r.randint(1, 4))}", f"{self.letters(2, 6)}_{d(3)}={d(r.randint(1, 9))}", f"https://{self.letters(3, 9)}.com/{self.letters(2, 8)}/{d(r.randint(1, 9))}",
            f"@{self.letters(3, 10)}", f"{d(1)} @ {d(2)}.{d(2)}", f"#{d(r.randint(2, 7))}", f"({d(r.randint(1, 4))})", f"[{d(r.randint(1, 3))}]", f"{d(3)} {d(3)}", f"{d(1)},{d(3)}.{d(2)}", f"{d(r.randint(1, 3))}%", f"({self.letters(2, 8)} at {self.letters(2, 8)})", f"+{d(r.randint(1, 4))}",
            f"{d(3)}-{d(3)}", f"{d(5)}-{d(4)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
        )

    def host(self, mark: str = ".") -> str:
        return mark.join([*(self.letters(2, 9) + self.one("", "", self.digits(1)) for _ in range(self.r.choice((1, 1, 2)))), self.one("com", "org", "net", "de", "fr", "co", "example", "io", self.letters(2, 4))])

    def person(self) -> str:
        return self.one("", self.letters(1, 8) + self.one(".", "_", "-", "")) + self.letters(2, 10) + self.one("", "", self.digits(2), self.digits(4))

    def email(self) -> str:
        at, dot = self.one((" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", "."), (" @ ", " . "), ("{at}", "{dot}"), ("<at>", "."), (" [AT] ", " [DOT] "))
        accent = "aeioulmnrstäöüéèß"
        return self.one(
            lambda: f"{self.person()}@{self.host()}", lambda: f"{self.person()}@{self.host()}", lambda: self.person() + at + self.host(dot), lambda: self.person() + at + self.host(dot), lambda: self.person() + at + self.host(dot),
            lambda: f"{self.letters(3, 9, accent)}.{self.letters(3, 9, accent)}@{self.host()}", lambda: f"{self.person()}@{self.letters(3, 9, accent)}.{self.one('de', 'fr', 'com')}",
        )()

    def ip(self) -> str:
        four = [str(self.r.randint(0, 255)) for _ in range(4)]
        six = [f"{self.r.getrandbits(16):x}" for _ in range(8)]
        k = self.r.randint(1, 6)
        return self.one(".".join(four), ".".join(four), self.one("[.]", "(.)", "[dot]", " . ").join(four), self.one("[.]", "(.)").join(four), ":".join(six), ":".join(six[:k]) + "::" + ":".join(six[k + 1 : 7]))

    def card(self) -> str:
        n = self.one(16, 16, 16, 15, 14, 13, 19)
        return self.one(self.digits(n), self.grouped(self.digits(n), 4, " "), self.grouped(self.digits(n), 4, "-"), self.grouped(self.digits(16), 4, self.one(".", "  ", " - ", "/", "_")), self.grouped(self.digits(16), 4, self.one(".", "  ", " - ", "/", "_")))

    def phone(self) -> str:
        d = self.digits
        return self.one(
            f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(2)} {d(7)}", f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"({d(3)}){d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"00{d(2)} {d(2)} {d(7)}", f"00{d(2)} {d(3)} {d(3)} {d(4)}",
            f"0{d(2)}/{d(7)}", f"0{d(3)}-{d(7)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(4)} {d(6)}", " ".join(["0" + d(1), *(d(2) for _ in range(4))]), ".".join(["0" + d(1), *(d(2) for _ in range(4))]), f"(0{d(2)}) {d(4)} {d(4)}",
        )

    def iban(self) -> str:
        country, n = self.one(("DE", 18), ("FR", 23), ("GB", 18), ("ES", 20), ("NL", 14), ("AT", 16), ("PL", 24), ("IT", 23))
        body = "".join(self.r.choices(self.one("0123456789", "0123456789", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), k=n))
        text = f"{country}{self.digits(2)}{body}"
        return self.one(text, self.grouped(text, 4, " "), self.grouped(text, 4, " "), self.grouped(text, 4, "-"))

    def ssn(self) -> str:
        return f"{self.digits(3)}-{self.digits(2)}-{self.digits(4)}" if self.r.random() < 0.8 else f"{self.digits(3)} {self.digits(2)} {self.digits(4)}"

    def example(self, size: int = WIDTH) -> tuple[str, list[tuple[int, int, int]]]:
        """(text of at least size characters, its (start, kind, end))."""
        parts, spans, n = [], [], 0
        while n < size:
            q = self.r.random()
            if q < 0.12:
                k = int(self.r.random() * len(TAGGED))
                body = getattr(self, TAGGED[k])()
                before, after = self.one("", "", "", "", "(", "<", '"', "tel:", "mail: ", ": "), self.one("", "", "", "", "", ",", ".", ")", ">", '"', ";")
                spans.append((n + len(before), k, n + len(before) + len(body)))
                body = before + body + after
            elif q < 0.28:
                body = self.decoy() + self.one("", "", "", ",", ".", ")", ";")
            else:
                body = self.word()
            body += self.one(" ", " ", " ", " ", " ", " ", "\n", "  ", " | ")
            parts.append(body)
            n += len(body)
        return "".join(parts), spans


def labelled(rng: random.Random, n: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, tags) of n windows of generated texts, (time, batch); some begin or end beyond the text."""
    codes, tags, maker = np.zeros((length, n), np.int64), np.zeros((length, n), np.int64), Maker(rng)
    for j in range(n):
        text, spans = maker.example(length + 40)
        own = np.zeros(len(text), np.int64)
        for s, k, e in spans:
            own[s], own[s + 1 : e] = 2 * k + 1, 2 * k + 2
        seen = symbols(text)
        at = rng.randrange(0, len(text) - length + 1) if rng.random() < 0.7 else 0
        pad = rng.randrange(0, MARGIN) if at == 0 and rng.random() < 0.7 else 0
        size = length - pad - (rng.randrange(0, MARGIN // 2) if rng.random() < 0.2 else 0)
        codes[pad : pad + size, j], tags[pad : pad + size, j] = seen[at : at + size], own[at : at + size]
    return codes, tags


@lru_cache(maxsize=1)
def trained() -> dict[str, np.ndarray]:
    """The weights, by Adam over TEXTS generated windows."""
    rng = np.random.default_rng(SEED)
    codes, tags = labelled(random.Random(SEED), TEXTS)
    net = Tagger.fresh(rng)
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    steps, total = 0, EPOCHS * (TEXTS // BATCH)
    for _ in range(EPOCHS):
        by = rng.permutation(TEXTS)
        for s in range(0, TEXTS - BATCH + 1, BATCH):
            steps += 1
            rate = RATE * min(1, steps / 20) * (1 - 0.95 * steps / total)
            _, grads = net.gradients(codes[:, by[s : s + BATCH]], tags[:, by[s : s + BATCH]])
            size = sum(float((g * g).sum()) for g in grads.values()) ** 0.5
            for k, g in grads.items():
                g = g * min(1, 5 / (size + 1e-9))
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.01 * (g * g - m2[k])
                net.w[k] -= (rate * (m1[k] / (1 - 0.9**steps)) / (np.sqrt(m2[k] / (1 - 0.99**steps)) + 1e-8)).astype(np.float32)
    return net.w


# --- texts -----------------------------------------------------------------------------------------------------------


def _blocks(text: str, everywhere: bool) -> np.ndarray:
    """The blocks to decode."""
    n = -(-len(text) // OWN)
    if everywhere:
        return np.arange(n)
    signs = np.unique(np.array([m.start() // OWN for m in _SIGN.finditer(text)], np.int64))
    near = np.unique(np.concatenate((signs - 1, signs, signs + 1)))
    return near[(near >= 0) & (near < n)]


def tag(texts: list[str], net: Tagger, everywhere: bool = False) -> Iterator[np.ndarray]:
    """The tags of each text."""
    rows = [(k, _blocks(t, everywhere)) for k, t in enumerate(texts)]
    out = [np.zeros(len(t), np.uint8) for t in texts]
    held: list[tuple[int, int]] = []
    windows: list[np.ndarray] = []

    def flush():
        codes = np.concatenate(windows, 1) if windows else np.zeros((WIDTH, 0), np.uint8)
        for lo in range(0, codes.shape[1], LOT):
            tags = net.decode(codes[:, lo : lo + LOT])[MARGIN : MARGIN + OWN]
            for j, (k, b) in enumerate(held[lo : lo + LOT]):
                own = out[k][b * OWN : (b + 1) * OWN]
                own[:] = tags[: len(own), j]
        held.clear()
        windows.clear()

    for k, blocks in rows:
        if not len(blocks):
            continue
        seen = np.zeros(len(texts[k]) + WIDTH + OWN, np.uint8)
        seen[MARGIN : MARGIN + len(texts[k])] = symbols(texts[k])
        for lo in range(0, len(blocks), LOT):
            some = blocks[lo : lo + LOT]
            windows.append(seen[np.arange(WIDTH)[:, None] + some * OWN])
            held += [(k, int(b)) for b in some]
            if len(held) >= LOT:
                flush()
    flush()
    yield from out


def _right(kind: str, text: str) -> bool:
    """What can be checked exactly of a tagged span."""
    d = _digits(text)
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "ssn":
        return len(d) == 9
    if kind == "iban":
        bare = re.sub(r"[\x20-]", "", text)
        return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}", bare)) and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    if kind == "ip":
        if ":" in text:
            return bool(re.fullmatch(r"[0-9A-Fa-f:]+", text)) and all(len(p) <= 4 for p in text.split(":")) and (text.count(":") == 7 if "::" not in text else text.count("::") == 1 and 3 <= text.count(":") <= 7)
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(map(_byte, parts)) and not re.search(r"[0-9]\s+[0-9]", text)
    return bool(re.search(r"\w.*(?:@|[\[({<]\x20?(?:at|AT)\x20?[\])}>]).*\w.*(?:\.|[\[({<]\x20?(?:dot|DOT)\x20?[\])}>]).*\w", text, re.S))


def tagged_spans(text: str, tags: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the spans that the tags tell, as numbers of ALL_KINDS."""
    kinds = (tags.astype(np.int64) + 1) // 2  # 0 outside
    edge = np.flatnonzero((np.diff(kinds, prepend=0) != 0) | (tags % 2 == 1))
    out = []
    for s in edge.tolist():
        k = int(kinds[s])
        if not k:
            continue
        e = s + 1
        while e < len(tags) and kinds[e] == k and tags[e] % 2 == 0:
            e += 1
        while e > s and text[e - 1] in " \t\n,;.:!?\"'>)":
            e -= 1
        while s < e and (text[s] in " \t\n,;:\"'<" or text[s] == "(" and ")" not in text[s:e]):
            s += 1
        name = TAGGED[k - 1]
        if e > s and _SIGN.search(text, s, e) and _right(name, text[s:e]) and not (name in KINDS and any(s < y and x < e for x, _, y in base)):
            out.append((s, len(KINDS) + k - 1, e))
    return out


def find_spans(texts: list[str], net: Tagger, everywhere: bool = False) -> list[list[tuple[int, int, int]]]:
    """All spans of each text, base ones included, by start and kind."""
    out = []
    for text, tags in zip(texts, tag(texts, net, everywhere), strict=True):
        base = base_spans(text) if everywhere or tags.any() or _SIGN.search(text) else []
        out.append(sorted([*base, *tagged_spans(text, tags, base)]) if tags.any() else base)
    return out


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array of (start, kind, end, value)) of every row; kind is a name of ALL_KINDS, places are code points."""
    weights = docs.sparkSession.sparkContext.broadcast(trained())
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("value", pa.string())]))

    def work(batches):
        net = Tagger(weights.value)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            found = [[{"start": s, "kind": ALL_KINDS[k], "end": e, "value": t[s:e]} for s, k, e in own] for t, own in zip(texts, find_spans(texts, net), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, span)], ["doc_id", "spans"])

    return text_rows(docs, id_col, text_col).mapInArrow(work, "doc_id long, spans array<struct<start:int,kind:string,end:int,value:string>>")
