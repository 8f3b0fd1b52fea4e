"""Line dedup: a log-template tree, in DataFrame functions only.

The tree has a fixed depth: a line (tokens parted by one space) goes by its token count and its DEPTH leading tokens to a
leaf; tokens with a digit are wildcards from the start. A line of LONG tokens or more is evidence by itself and recurs from
RECUR_LONG texts on, a shorter one from RECUR. Leaves that fewer texts reach cannot hold a recurring template and end
there. In the others a token is constant where so many texts have it at its place, and a wildcard elsewhere: that is the
line's template, provided at least SIMILAR of its tokens are constant. A template of so many texts recurs; its first line
(least document, then line) stays and all others are dropped from their documents.

Texts are counted by their content, so exact copies of one document count once. Lines are counted with map-side combine
(a leaf's lines, tokens and templates are sums and minima), so a line that a third of all documents hold costs one row a
task. What is joined back is broadcast only up to BROADCAST_ROWS rows, else shuffled.

Defined results: null text is empty; blank lines are never dropped; a document all of whose lines are dropped has an
empty text; rows with equal doc_id and text share their verdict; a null doc_id sorts last; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, staged, text_rows, unused

DEPTH, RECUR, SIMILAR = 3, 10, 0.75
LONG, RECUR_LONG = 8, 3
BROADCAST_ROWS = 1_000_000
_VARIABLE = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*"


def masked(text: Column) -> Column:
    return F.regexp_replace(text, _VARIABLE, "<*>")


def n_tokens(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def leaf(line: Column, depth: int) -> Column:
    return F.xxhash64(n_tokens(line), masked(F.substring_index(line, " ", depth)))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def needed(n: Column, recur: int, recur_long: int) -> Column:
    """In how many texts a line of n tokens must recur."""
    return F.when(n >= LONG, min(recur, recur_long)).otherwise(recur)


def recurring_lines(docs: DataFrame, depth: int = DEPTH, recur: int = RECUR, similar: float = SIMILAR, recur_long: int = RECUR_LONG) -> DataFrame:
    """(doc_id, rk, drops array<int>): the line numbers to drop of each document that loses any."""
    rows = text_rows(docs).withColumn("th", F.xxhash64("text")).withColumn("rk", F.xxhash64("doc_id", "th"))
    lines = rows.select("doc_id", "rk", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    lines = lines.withColumns({"leaf": leaf(F.col("line"), depth), "least": needed(n_tokens(F.col("line")), recur, recur_long)})
    full = lines.groupBy("leaf", "least", "th").agg(F.lit(1).alias("one")).groupBy("leaf", "least").agg(F.count("*").alias("d")).where("d >= least").select("leaf")
    full = staged(full, "leaves")
    here = lines.join(_few(full), "leaf").withColumn("m", masked(F.col("line")))
    kinds = here.groupBy("leaf", "least", "m", "th").agg(F.lit(1).alias("one")).groupBy("leaf", "least", "m").agg(F.count("*").alias("d"))
    kinds = staged(kinds, "kinds")
    tokens = kinds.select("leaf", "least", F.xxhash64("m").alias("mh"), "d", F.posexplode(F.split("m", " ")).alias("at", "token"))
    common = tokens.groupBy("leaf", "least", "at", "token").agg(F.sum("d").alias("texts")).where((F.col("texts") >= F.col("least")) & (F.col("token") != "<*>")).drop("texts", "least")
    constant = tokens.join(common, ["leaf", "at", "token"]).groupBy("leaf", "mh").agg(F.count("*").alias("constants"), F.sum(F.xxhash64("at", "token").cast("decimal(20,0)")).alias("signature"))
    sizes = kinds.select("leaf", "least", F.xxhash64("m").alias("mh"), "d", n_tokens(F.col("m")).alias("n"))
    templates = sizes.join(constant, ["leaf", "mh"]).where(F.col("constants") >= similar * F.col("n"))
    templates = templates.select("leaf", "mh", "d", "least", F.xxhash64("leaf", "signature").alias("template"))
    often = templates.groupBy("template", "least").agg(F.sum("d").alias("texts")).where("texts >= least").select("template")
    hit = staged(templates.join(often, "template").select("leaf", "mh", "template"), "templates")
    found = here.select("leaf", F.xxhash64("m").alias("mh"), "doc_id", "rk", "line_no").join(_few(hit), ["leaf", "mh"]).select("template", "doc_id", "rk", "line_no")
    found = staged(found, "lines")
    place = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("rk").alias("r"), F.col("line_no").alias("n"))
    first = found.groupBy("template").agg(F.min(place).alias("p"))
    later = found.join(_few(first), "template").where((F.col("rk") != F.col("p.r")) | (F.col("line_no") != F.col("p.n")))
    return later.groupBy("doc_id", "rk").agg(F.array_sort(F.collect_set("line_no")).alias("drops"))  # bounded by the document's lines


def drop_recurring_lines(docs: DataFrame, depth: int = DEPTH, recur: int = RECUR, similar: float = SIMILAR, counts: bool = True, recur_long: int = RECUR_LONG) -> DataFrame:
    """docs with text less its dropped lines; with `counts`, n_lines and n_dropped stand behind the columns of docs (or
    in the place of columns of these names)."""
    id_, rk, gone_ = unused(docs, "id", "rk", "drops")
    drops = staged(recurring_lines(docs, depth, recur, similar, recur_long), "drops").select(F.col("doc_id").alias(id_), F.col("rk").alias(f"{rk}_"), F.col("drops").alias(gone_))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn(rk, F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(text)))
    # The id stands beside the hash, so that no other document can lose lines by a collision.
    joined = keyed.join(drops.hint("merge"), (F.col(rk) == F.col(f"{rk}_")) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_)), "left")
    lines = F.split(text, "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(gone_), i)), "\n")
    gone = F.col(gone_).isNotNull()
    out = {c: F.when(gone, kept).otherwise(F.col(c)) if c == "text" else F.col(quoted(c)) for c in docs.columns}
    if counts:
        out |= {"n_lines": F.size(lines).cast("long"), "n_dropped": F.when(gone, F.size(gone_)).otherwise(0).cast("long")}
    return joined.select(*(v.alias(c) for c, v in out.items()))
