"""Secrets in texts: patterns, and Shannon entropy in sliding windows (DataFrame functions only).

Base kinds are assign, access and hex. The method adds ``entropy``: every other run of 20 or more characters that
tokens are made of is a candidate; a window slides over it, the counts of its characters change by one in and one out,
and so does the sum of c * log2(c) that the entropy follows from. Each character class has its own threshold, and an
allow-list suppresses what is known to be harmless (UUIDs, alphabets, paths, joined words, documentation's keys).
What is harmless inside a candidate is cut out, and the pieces between are scored: one that is random enough makes the
whole candidate a span. Base spans are cut out of texts before, so what stands beside them is a candidate of its own.
Letters in one case reach their threshold seldom, and words joined by marks without a digit count as harmless.

Defined results: a null or empty text has no spans; texts of any length are searched whole; repeated rows are treated
alike; other columns pass through whatever their names, those named secret_* are replaced; no documents give no rows.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.spans import blanked, spans

KINDS = ("assign", "access", "hex", "entropy")
#: A value is 6 characters or more, checked after the match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_LONG = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}$"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
#: The window, and the bits a window must reach by character class.
WINDOW = 20
BITS = {"hex": 2.9, "lower": 3.4, "mixed": 3.6, "letters": 3.8}
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"


def _row(least: str, more: str) -> str:
    """A pattern of least and as much of more as follows in order."""
    return least + "".join(f"(?:{c}" for c in more) + ")?" * len(more)


#: What is cut out of candidates: alphabets and keyboard rows, documentation's keys, paths' words, one character repeated.
HARMLESS = "|".join((
    "(?i:" + "|".join((_row("abcdefgh", "ijklmnopqrstuvwxyz"), _row("qwerty", "uiop"), _row("01234567", "89"), _row("12345678", "90"), "EXAMPLE", "placeholder", "x{6,}+")) + ")",
    r"(?<![A-Za-z0-9+=])(?:[A-Za-z]{2,19}[/_-]){2,}+",
    r"(?<same>.)\k<same>{7,}+",
))
#: What is suppressed as a whole, a candidate or a piece of it: UUIDs, words and numbers joined by marks, numbers.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"^[A-Za-z]{1,19}([-_/=+]+[A-Za-z]{1,19})*[-_/=+]*$",
    r"^[A-Za-z]{2,19}([-_/][A-Za-z]{2,19}|[-_/][0-9]{1,8})*$",
    r"^[0-9+/_=-]+$",
)


def window_entropy(candidate: Column, width: int = WINDOW) -> Column:
    """The largest entropy, in bits, of width characters in a row; null for shorter strings."""
    table = F.array(*[F.lit(c * log2(c) if c else 0.0) for c in range(width + 2)])
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("least"))
    term = lambda n: F.element_at(table, n + 1)  # noqa: E731  array indices count from 1

    def over(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            into = F.element_at(codes, i) + 1
            out = F.when(i > width, F.element_at(codes, F.greatest(i - width, F.lit(1))) + 1).otherwise(0)
            n_in, n_out = F.element_at(state["n"], into), F.element_at(state["n"], F.greatest(out, F.lit(1)))
            s = F.when(into == out, state["s"]).otherwise(state["s"] + term(n_in + 1) - term(n_in) + F.when(out > 0, term(F.greatest(n_out - 1, F.lit(0))) - term(n_out)).otherwise(0.0))
            n = F.transform(state["n"], lambda x, j: x + (j + 1 == into).cast("int") - (j + 1 == out).cast("int"))
            least = F.when(i < width, s).when(i == width, s).otherwise(F.least(state["least"], s))
            return F.struct(n.alias("n"), s.alias("s"), least.alias("least"))

        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, step, lambda z: F.lit(log2(width)) - z["least"] / width)

    return F.when(F.char_length(candidate) >= width, F.element_at(F.transform(F.array(codes), over), 1))


def _allowed(candidate: Column) -> Column:
    allowed = candidate.rlike(ALLOWED[0])
    for pattern in ALLOWED[1:]:
        allowed = allowed | candidate.rlike(pattern)
    return allowed


def _random(piece: Column) -> Column:
    digit, upper, lower = piece.rlike("[0-9]"), piece.rlike("[A-Z]"), piece.rlike("[a-z]")
    need = F.when(~digit, F.lit(BITS["letters"])).when(piece.rlike("^[0-9A-F]+$|^[0-9a-f]+$"), F.lit(BITS["hex"])).when(upper & lower, F.lit(BITS["mixed"])).otherwise(F.lit(BITS["lower"]))
    return F.when((F.char_length(piece) >= WINDOW) & (upper | lower) & ~_allowed(piece), window_entropy(piece) >= need).otherwise(False)


def suspicious(candidate: Column) -> Column:
    """Whether a piece of a candidate, without what is harmless, has a window random enough for its character class."""
    pieces = F.split(F.regexp_replace(candidate, HARMLESS, " "), " ")
    return F.when(_allowed(candidate), False).otherwise(F.exists(pieces, _random))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``secret_base`` (spans of the base kinds by start, then kind) and ``secret_spans`` (all, likewise)."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = F.concat(spans(t, ASSIGN, "assign", lambda m: m.rlike(ASSIGN_LONG)), spans(t, ACCESS, "access", may=F.contains(t, F.lit("AKIA"))), spans(t, HEX, "hex"))
    order = {k: i for i, k in enumerate(KINDS)}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    by_start = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(rank[a["kind"]] - rank[b["kind"]])
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if not c.lower().startswith("secret_")])
    with_base = rest.withColumn("secret_base", F.array_sort(base, by_start))
    found = spans(blanked(t, F.col("secret_base")), CANDIDATE, "entropy", suspicious)
    return with_base.withColumn("secret_spans", F.array_sort(F.concat("secret_base", found), by_start))
