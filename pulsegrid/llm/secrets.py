"""Secret scans: character Markov models, in DataFrame functions only.

Base rules find assignments of secrets, access keys and long hexadecimal runs. Besides, every run of identifier
characters that has a digit, a capital after a small letter, or LONG characters is judged by two first-order Markov
models over ASCII:

* random strings: strings drawn from the usual alphabets of keys (generated, so labelled by their making), mixed half and
  half with the values that the base rules find in all documents;
* ordinary identifiers: names of Python's standard library and compounds of their words (paths, hosts, dates, versions,
  snake, camel and kebab case, with and without numbers), mixed half and half with the words of all documents that read as
  words (each distinct word once).

Along a run the log-likelihood ratio of random to ordinary is summed up; the sum starts anew where it falls to zero, so it
peaks at the end of a stretch that looks random, wherever that lies in the run. A stretch whose peak reaches EVIDENCE is a
secret (kind ``markov``). It is widened to the next ``/`` or ``.`` on either side, stretches that then meet are one, and one
that a base span overlaps is left out. Nothing is judged below LEAST characters, nor runs of letters alone that are shorter
than LONG and change no case.

The models are counts of character pairs, whatever the corpus, so they go to the driver and back as a literal. Each text
is scanned once where it lies, and once more for its words; what is found is written to the shared folder. Places come
from splitting a text by the pattern and adding up lengths.

Defined results: null text is empty and has no spans; repeated rows are scanned each; a null doc_id is kept; an empty
table gives no rows; without any base values or words in the documents the generated samples stand alone; other columns
are ignored.
"""

from __future__ import annotations

import importlib
import math
import random
import re
import string
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_rows

# The base rules.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the runs [0-9a-f]+ of 24 characters or more: a match from a run's first place on is the whole run
KINDS = ("assign", "access", "hex", "markov")
LEAST, LONG, LOT = 8, 16, 256
_ANY = "A-Za-z0-9+/_=.-"
# A run with a digit, with a capital after a small letter, or a long one; all three match from the run's first place on.
RUN = rf"[A-Za-z+/_=.-]*+[0-9][{_ANY}]*+|[A-Z+/_=.-]*+[a-z+/_=.-]++[A-Z][{_ANY}]*+|[{_ANY}]{{{LONG},}}+"
WORD = rf"[{_ANY}]{{2,}}+"
# Runs that read as words (camel, snake or kebab case, paths, host names, short numbers) are the labelled ordinary identifiers.
ORDINARY = r"^(?:(?:(?:[A-Z]?[a-z]{2,}+)++|[A-Z]{2,}+)?+(?:[0-9]{1,4}+)?+(?:[_+/.=-]++|$))++$"
SIZE = 128
EVIDENCE, SMOOTH, BACKOFF, SCALE = 11.0, 0.5, 8, 100
_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"
# Modules whose names are sampled.
MODULES = (
    "argparse asyncio calendar collections configparser csv datetime decimal difflib email.message fractions ftplib functools gettext http.client http.server imaplib inspect io json locale "
    "logging logging.handlers mailbox multiprocessing os pathlib pickle shutil smtplib socket sqlite3 ssl statistics string subprocess tarfile tempfile threading tokenize traceback unittest "
    "urllib.parse urllib.request xml.dom.minidom zipfile"
).split()
_U, _L, _D = string.ascii_uppercase, string.ascii_lowercase, string.digits
ALPHABETS = (_D + "abcdef", _D + "ABCDEF", _U + "234567", _L + _D, _U + _D, _U + _L + _D, _U + _L + _D + "+/", _U + _L + _D + "-_", _U + _L)


def random_strings(n: int = 500, length: int = 32, seed: int = 1) -> list[str]:
    """n strings of each alphabet of keys."""
    rng = random.Random(seed)
    return ["".join(rng.choices(a, k=length)) for a in ALPHABETS for _ in range(n)]


def _names() -> list[str]:
    out = set()
    for m in MODULES:
        try:
            module = importlib.import_module(m)
        except ImportError:  # a module that this Python was built without
            continue
        for name in dir(module):
            out.add(name)
            if isinstance(value := getattr(module, name, None), type):
                out.update(dir(value))
    return sorted(x for x in (n.strip("_") for n in out) if len(x) > 2 and x.isascii())


def ordinary_identifiers(n: int = 20_000, seed: int = 7, parts: list[str] | None = None) -> list[str]:
    """Names of the standard library and n compounds of their words (or of the given ones alone)."""
    names = [] if parts else _names()
    parts = parts or sorted({p.lower() for x in names for p in re.findall(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}", x)})
    rng = random.Random(seed)
    number = lambda: str(rng.choice([rng.randint(0, 9), rng.randint(0, 99), rng.randint(1900, 2099), rng.randint(100, 999), rng.randint(10_000, 10**9)]))
    out = list(names)
    for k in range(n):
        w = [rng.choice(parts) for _ in range(rng.randint(1, 4))]
        title = [x.capitalize() for x in w]
        forms = (
            "_".join(w), rng.choice(["", "/"]) + "/".join(w) + rng.choice(["", ".html", ".py", ".txt", ".json", "/"]), ".".join(w) + rng.choice([".com", ".org", ".net", ""]),
            w[0] + "".join(title[1:]), "_".join(w).upper(), "-".join(w), "".join(title),
            rng.choice([
                f"{rng.randint(1990, 2039)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}" + rng.choice(["", f"T{rng.randint(0, 23):02}"]),
                rng.choice(["v", ""]) + ".".join(str(rng.randint(0, 20)) for _ in range(3)), ".".join(number() for _ in range(4)), f"{number()}-{number()}", number(),
            ]),
        )
        v = forms[k % len(forms)]
        if k % len(forms) < len(forms) - 1:
            v += rng.choice(["", "_", "-", "."]) + number() if rng.random() < 0.4 else ""
            v = number() + rng.choice(["", "_", "-"]) + v if rng.random() < 0.1 else v
        out.append(v)
    return out


def pair_counts(samples: list[str]) -> list[int]:
    counts = [0] * SIZE * SIZE
    for s in samples:
        for a, b in zip(s, s[1:]):
            counts[ord(a) * SIZE + ord(b)] += 1
    return counts


def probabilities(counts: list[int]) -> list[float]:
    """p(y | x) of each pair: each character's followers, smoothed by how often they follow any."""
    after = [SMOOTH + sum(counts[y::SIZE]) for y in range(SIZE)]
    whole = sum(after)
    rows = [counts[x * SIZE : (x + 1) * SIZE] for x in range(SIZE)]
    return [(n + BACKOFF * after[y] / whole) / (sum(row) + BACKOFF) for row in rows for y, n in enumerate(row)]


@lru_cache(maxsize=1)
def _generated() -> tuple[list[float], list[float]]:
    return probabilities(pair_counts(ordinary_identifiers())), probabilities(pair_counts(random_strings()))


def ratios(ordinary: list[int], found: list[int]) -> list[int]:
    """SCALE * log(p(y | x, random) / p(y | x, ordinary)) of each pair, from the counts of the documents."""
    own = [[(a + b) / 2 for a, b in zip(p, probabilities(c), strict=True)] if any(c) else p for p, c in zip(_generated(), (ordinary, found), strict=True)]
    return [round(SCALE * math.log(r / o)) for o, r in zip(*own, strict=True)]


def _none() -> Column:
    return F.expr(f"cast(array() as {_SPANS})")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once (an expression in a lambda would be computed for each element)."""
    return F.transform(F.array(value), body)[0]


def spans(text: Column, pattern: str, kind: int, least: int = 0, group: int = 0) -> Column:
    """array<struct<start, kind, end, value>>: leftmost matches that do not overlap, in code points; those whose group
    (the value) has fewer than `least` characters are dropped."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)  # one piece before each match, one after the last
    each = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("match"), value.alias("value"))
    start = F.struct(F.lit(0).alias("at"), _none().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.char_length(x["gap"])
        b = a + F.char_length(x["match"])
        new = F.struct(a.alias("start"), F.lit(kind).alias("kind"), b.alias("end"), x["value"].alias("value"))
        return F.struct(b.alias("at"), F.when(F.char_length(x["value"]) >= least, F.concat(acc["out"], F.array(new))).otherwise(acc["out"]).alias("out"))

    def placed(each: Column) -> Column:
        # Matches are added up in lots, and the lots' lengths by themselves, so that no long array grows one by one.
        lots = F.transform(F.sequence(F.lit(1), F.size(each), F.lit(LOT)), lambda i: F.aggregate(F.slice(each, i, LOT), start, step))
        return _let(lots, shifted)

    def shifted(lots: Column) -> Column:
        at = F.aggregate(lots, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
        return F.flatten(F.zip_with(lots, F.slice(at, F.lit(1), F.size(lots)), lambda x, by: F.transform(x["out"], lambda m: F.struct((m["start"] + by).alias("start"), m["kind"].alias("kind"), (m["end"] + by).alias("end"), m["value"].alias("value")))))

    return F.when(text.rlike(pattern), _let(each, placed)).otherwise(_none())


def scan(rows: DataFrame) -> DataFrame:
    """Adds assign, access, hex and runs to (.., text), and takes the text away."""
    t = F.col("text")
    return rows.select(*(c for c in rows.columns if c != "text"), spans(t, ASSIGN, 0, 6, 2).alias("assign"), spans(t, ACCESS, 1, 20).alias("access"), spans(t, HEX, 2, 24).alias("hex"), spans(t, RUN, 3, LEAST).alias("runs"))


def _pairs(value: Column) -> Column:
    """The character pairs of a value as numbers below SIZE * SIZE."""
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c))
    return F.zip_with(F.slice(codes, F.lit(1), F.char_length(value) - 1), F.slice(codes, F.lit(2), F.char_length(value)), lambda x, y: x * SIZE + y)


def _counted(values: DataFrame) -> list[int]:
    """Counts of the pairs of a column of values."""
    counts = [0] * SIZE * SIZE
    pairs = values.where(F.char_length("value") > 1).select(F.explode(_pairs(F.col("value"))).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    for r in pairs.collect():  # at most SIZE * SIZE rows
        counts[r["k"]] = r["n"]
    return counts


def train(rows: DataFrame, found: DataFrame) -> list[int]:
    """The ratios, from all rows' words and the base spans found in them."""
    words = rows.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("value")).distinct()
    values = found.select(F.explode(F.concat("assign", "access", "hex")).alias("s")).select("s.value")
    return ratios(_counted(words.where(F.col("value").rlike(ORDINARY))), _counted(values))


def _stretches(run: Column, table: Column, evidence: float) -> Column:
    """The spans of a run's stretches whose evidence peaks high enough."""
    value = run["value"]
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("sum"), F.lit(0).alias("best"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("out")
    )
    enough = round(SCALE * evidence)

    def told(acc: Column) -> Column:
        return F.when(acc["best"] >= enough, F.concat(acc["out"], F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b"))))).otherwise(acc["out"])

    def step(acc: Column, k: Column) -> Column:
        s = acc["sum"] + F.element_at(table, k + 1)
        at = acc["at"] + 1
        anew = F.struct(at.alias("at"), F.lit(0).alias("sum"), F.lit(0).alias("best"), at.alias("a"), at.alias("b"), told(acc).alias("out"))
        peak = F.struct(at.alias("at"), s.alias("sum"), s.alias("best"), acc["a"].alias("a"), (at + 1).alias("b"), acc["out"].alias("out"))
        on = F.struct(at.alias("at"), s.alias("sum"), acc["best"].alias("best"), acc["a"].alias("a"), acc["b"].alias("b"), acc["out"].alias("out"))
        return F.when(s <= 0, anew).when(s > acc["best"], peak).otherwise(on)

    def widened(x: Column) -> Column:
        before = F.substring_index(F.substring_index(F.substr(value, F.lit(1), x["a"]), "/", -1), ".", -1)
        after = F.substring_index(F.substring_index(F.substr(value, x["b"] + 1, F.char_length(value)), "/", 1), ".", 1)
        return F.struct((run["start"] + x["a"] - F.char_length(before)).alias("a"), (run["start"] + x["b"] + F.char_length(after)).alias("b"))

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))
        return F.when((F.size(acc) > 0) & (x["a"] <= last["b"]), joined).otherwise(F.concat(acc, F.array(x)))

    none = F.expr("cast(array() as array<struct<a:int,b:int>>)")
    merged = F.aggregate(F.transform(F.aggregate(_pairs(value), start, step, told), widened), none, merge)
    whole = F.transform(merged, lambda x: F.struct(x["a"].alias("start"), F.lit(3).alias("kind"), x["b"].alias("end"), F.substr(value, x["a"] - run["start"] + 1, x["b"] - x["a"]).alias("value")))
    return F.filter(whole, lambda x: F.char_length(x["value"]) >= LEAST)


def find_secrets(docs: DataFrame, evidence: float = EVIDENCE) -> DataFrame:
    """(doc_id, spans array<struct<start, kind, end, value>>) per row, by start, then kind as in KINDS."""
    rows = text_rows(docs)
    found = staged(scan(rows), "secrets")
    table = F.split(F.lit(",".join(map(str, train(rows, found)))), ",").cast("array<int>")  # folded into one literal
    base = F.concat("assign", "access", "hex")
    likely = F.flatten(F.transform("runs", lambda r: _stretches(r, table, evidence)))
    more = F.filter(likely, lambda r: ~F.exists(base, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    more = F.when(F.size("runs") > 0, more).otherwise(_none())
    return found.select("doc_id", F.array_sort(F.concat(base, more)).alias("spans"))


def spell(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")
