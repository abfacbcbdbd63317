"""Operator 7: secret scans by patterns and by sliding-window entropy, with SQL functions only.

Base kinds are leftmost non-overlapping matches of three patterns. The method adds spans of kind
``entropy``: in candidate strings (runs of ``MIN_RUN`` or more characters of the base-64 and
identifier alphabets) a window of ``WINDOW`` characters slides. A candidate belongs to the class of
hexadecimal or of mixed characters, each with its symbols and a threshold of its own. The counts of
the class's symbols in the window are carried from step to step; the symbol that enters and the one
that leaves change two of them and the entropy by their terms. The span runs from the first window
above the threshold to the end of the last. Candidates on the allow list (plain words, numbers,
UUIDs, counting sequences, placeholders) are suppressed. Spans of other kinds do not matter: what a
base pattern finds and is random as well is reported twice.

Scale: one pass, no shuffle; a cheap test decides whether a text is looked at closely at all, and
work on a text grows with its candidates.

Defined results: null text is the empty text, without spans; offsets are code points, ends
exclusive; other columns are ignored (``scan_secrets`` keeps them); repeated rows give repeated
rows; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, fresh

KINDS = ("assign", "access", "hex", "entropy")
#: kind: pattern, group whose length counts, least length.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # Runs of these two are whole runs, so the least length can stand in the pattern.
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: A text in which this finds nothing has no span of kind assign.
WORDS = r"(?i)password|passwd|secret|token|api_?key"
MIN_RUN = 20
WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{MIN_RUN},}}={{0,2}}"
#: class: its symbols, least entropy in bits a character. A candidate is of the first class that has all its characters.
CLASSES = {
    "hexadecimal": ("0123456789ABCDEFabcdef", 3.0),
    "mixed": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", 3.7),
}
ALLOW = (
    r"^[0-9=_+/-]*$",  # numbers
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx|0123456789|abcdefgh",
)
#: Strings of these alone are words: in lower or upper case, capitalised, and what joins them.
WORD_PARTS = "[A-Z]?[a-z]{2,}|[A-Z]{2,}|[=_+/-]"
SPAN = "array<struct<start:int,rank:int,end:int>>"


def located(text: Column, pattern: str, group: int) -> Column:
    """Array of (start, end, size) of a pattern's matches; size: characters of the group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.char_length).alias("gap"),
        F.transform(whole, F.char_length).alias("width"),
        F.transform(part, F.char_length).alias("size"),
    )
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,size:int>>").alias("found"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + x["width"]
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end"), x["size"].alias("size")))).alias("found"))

    # One more gap than matches: the last is dropped.
    return F.aggregate(F.slice(steps, 1, F.size(whole)), begin, step, lambda acc: acc["found"])


def base_spans(text: Column, kind: str, long_run: Column) -> Column:
    """long_run: whether the text has a candidate; without one, runs of kinds access and hex are too short."""
    pattern, group, least = BASE[kind]
    kept = F.filter(located(text, pattern, group), lambda x: x["size"] >= least)
    spans = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end")))
    hint = long_run & text.rlike(pattern)
    if kind == "assign":
        hint = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(WORDS)
    return F.when(hint, spans).otherwise(F.array().cast(SPAN))


def _part(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(0.0)


def entropy_span(run: Column, least: Column, symbols: str = CLASSES["mixed"][0]) -> Column:
    """(first, last) end positions of the windows of ``run`` above the threshold, (0, 0) without any.

    H = log2(W) - sum(c * log2(c)) / W: a step changes the sum for two symbols only."""
    begin = F.struct(F.lit(0.0).alias("sum"), F.array_repeat(F.lit(0), len(symbols)).alias("counts"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def place(i):
        return F.instr(F.lit(symbols), F.substring(run, i, 1)) - 1

    def count(acc, at):
        return F.get(acc["counts"], at)

    def step(acc, i):
        full, enters, leaves = i > WINDOW, place(i), place(i - WINDOW)
        n_in, n_out = count(acc, enters), count(acc, leaves) + (enters == leaves).cast("int")
        grown = acc["sum"] + _part(n_in + 1) - _part(n_in)
        total = F.when(full, grown + _part(n_out - 1) - _part(n_out)).otherwise(grown)
        counts = F.transform(acc["counts"], lambda c, k: c + (k == enters).cast("int") - (full & (k == leaves)).cast("int"))
        high = (i >= WINDOW) & (F.log2(F.lit(float(WINDOW))) - total / WINDOW >= least)
        return F.struct(total.alias("sum"), counts.alias("counts"), F.when(high & (acc["first"] == 0), i).otherwise(acc["first"]).alias("first"), F.when(high, i).otherwise(acc["last"]).alias("last"))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(run)), begin, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def allowed(run: Column) -> Column:
    known = F.exists(F.array(*map(F.lit, ALLOW)), lambda a: F.regexp_like(run, a))
    return known | (F.regexp_replace(run, WORD_PARTS, "") == "")


def entropy_spans(text: Column, long_run: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    placed = F.arrays_zip(runs.alias("run"), located(text, CANDIDATE, 0).alias("at"))
    wanted = F.filter(placed, lambda x: ~allowed(x["run"]))
    (narrow, least), (wide, other) = CLASSES.values()

    def scored(x):
        hexadecimal = F.translate(x["run"], narrow, "") == ""
        hit = F.when(hexadecimal, entropy_span(x["run"], F.lit(least), narrow)).otherwise(entropy_span(x["run"], F.lit(other), wide))
        return F.struct(x["at"]["start"].alias("start"), hit.alias("hit"))

    high = F.filter(F.transform(wanted, scored), lambda x: x["hit"]["last"] > 0)
    spans = F.transform(high, lambda x: F.struct((x["start"] + x["hit"]["first"] - WINDOW).alias("start"), F.lit(KINDS.index("entropy")).alias("rank"), (x["start"] + x["hit"]["last"]).alias("end")))
    return F.when(long_run, spans).otherwise(F.array().cast(SPAN))


def scan_secrets(docs: DataFrame, text="text") -> DataFrame:
    """``docs`` with one more column ``secrets``: base and all, sorted arrays of (start, rank, end);
    rank: place of the kind in KINDS. A column of this name is replaced."""
    name, run = fresh(docs.columns, "ss_text"), fresh(docs.columns, "ss_run")
    found = docs.withColumn(name, F.coalesce(F.col(text), F.lit(""))).withColumn(run, F.col(name).rlike(CANDIDATE))
    base = F.array_sort(F.concat(*[base_spans(F.col(name), k, F.col(run)) for k in BASE]))
    found = found.withColumn("secrets", F.struct(base.alias("base"), entropy_spans(F.col(name), F.col(run)).alias("added")))
    return found.withColumn("secrets", F.struct(F.col("secrets.base").alias("base"), F.array_sort(F.concat("secrets.base", "secrets.added")).alias("all"))).drop(name, run)


def joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"], x["end"])), ",")


def op7(spark, sf_dir):
    found = scan_secrets(documents(spark, sf_dir).select("doc_id", "text"))

    def count(rank):
        return F.size(F.filter("secrets.base", lambda x: x["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")

    return found.select("doc_id", *map(count, range(len(BASE))), F.sha2(joined(F.col("secrets.base")), 256).alias("base_sha256"), joined(F.col("secrets.all")).alias("spans"))
