"""Fill-in-the-middle: texts cut at unit boundaries into prefix, middle and suffix, and put together in another order.

A unit grammar becomes a regular expression of no width: a place between two neighbouring characters, told by the class
of the one and of the other. Spark's split at these places keeps every character, so pieces joined are the text.

Defined results: null is the empty text; the empty text has no unit and stays plain, and so does a text that holds one of
the marks; a null id is hashed as the empty string; equal rows and equal ids get equal cuts. A text of any length is one
array of its units. Empty tables give no rows. Other columns stay; columns named like the new ones (in any case) are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Characters of the hex digest that make one number, and how many numbers are taken.
DIGITS, NUMBERS = 8, 4


@dataclass(frozen=True)
class Grammar:
    """A unit grammar over a class of characters, written as the inside of brackets in a regular expression.

    closed: ``[^C]*C|[^C]+`` (a unit ends with its first character of the class). opened: ``C[^C]*|[^C]+`` (it begins
    with one). runs: ``C+|[^C]+``. led: ``C*[^C]+|C+`` (a run of the class and what follows it up to the next run).
    """

    form: str
    chars: str

    def boundary(self) -> str:
        """The places between two units: what may stand before, and what after."""
        inside, outside, any_ = f"[{self.chars}]", f"[^{self.chars}]", r"[\s\S]"
        between = lambda before, after: f"(?<={before})(?={after})"
        return {
            "closed": between(inside, any_),
            "opened": between(any_, inside),
            "runs": f"{between(inside, outside)}|{between(outside, inside)}",
            "led": between(outside, inside),
        }[self.form]


GRAMMARS = {
    "lines": Grammar("closed", r"\n"),
    "sentences": Grammar("closed", r".!?"),
    "words": Grammar("led", r"\s"),
    "runs": Grammar("runs", r"A-Za-z0-9"),
}


def units(text: Column, grammar: Grammar) -> Column:
    """The units in order; none of the empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary(), -1))


def numbers(ids: Column, seed: int) -> list[Column]:
    """The first NUMBERS groups of DIGITS hex digits of the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ids.cast("string"), F.lit(""))), 256)
    group = lambda i: F.conv(F.substring(digest, 1 + DIGITS * i, DIGITS), 16, 10).cast("long")
    return [group(i) for i in range(NUMBERS)]


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. The text holds no mark unless it is plain, so marks cut the output."""
    part = F.split(output, "|".join(MARKS), -1)
    prefix, suffix = F.when(form == "psm", part[1]).otherwise(part[2]), F.when(form == "psm", part[2]).otherwise(part[1])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, part[3], suffix))


def transform(
    docs: DataFrame, grammar: Grammar = GRAMMARS["lines"], seed: int = 7, rate: int = 100, spm: int = 50, ids: str = "doc_id", text: str = "text"
) -> DataFrame:
    """docs with fim_units, fim_form (plain, psm or spm), fim_prefix_chars, fim_middle_chars (code points, null if plain)
    and fim_output.

    rate: of a hundred documents, how many are changed. spm: of a hundred of these, how many get the suffix first.
    """
    made = ("fim_units", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output")
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    steps = "fim input"  # no column of a table read by name holds a space and clashes with it; checked below
    while steps in docs.columns:
        steps += " "
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    h = numbers(F.col(f"`{ids}`"), seed)
    cut = docs.select(*own, F.struct(whole.alias("text"), units(whole, grammar).alias("units"), *[x.alias(f"h{i}") for i, x in enumerate(h)]).alias(steps))
    at = F.col(f"`{steps}`")
    n = F.size(at["units"]).cast("long")
    low, high = (pick(at["h0"] % (n + 1), at["h1"] % (n + 1)).cast("int") for pick in (F.least, F.greatest))
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains(at["text"], F.lit(m))
    form = F.when((n == 0) | marked | (at["h2"] % 100 >= rate), "plain").when(at["h3"] % 100 < spm, "spm").otherwise("psm")
    piece = lambda start, length: F.array_join(F.slice(at["units"], start + 1, length), "")
    pieces = {"prefix": piece(F.lit(0), low), "middle": piece(low, high - low), "suffix": piece(high, n.cast("int") - high)}
    parts = cut.select(*own, F.struct(at["text"].alias("text"), n.alias("n"), form.alias("form"), *[v.alias(k) for k, v in pieces.items()]).alias(steps))
    p, s, m = MARKS
    psm = F.concat(F.lit(p), at["prefix"], F.lit(s), at["suffix"], F.lit(m), at["middle"])
    spm_ = F.concat(F.lit(s), at["suffix"], F.lit(p), at["prefix"], F.lit(m), at["middle"])
    chars = lambda c: F.when(at["form"] != "plain", F.char_length(at[c]).cast("long"))
    output = F.when(at["form"] == "plain", at["text"]).when(at["form"] == "psm", psm).otherwise(spm_)
    return parts.select(*own, at["n"].alias("fim_units"), at["form"].alias("fim_form"), chars("prefix").alias("fim_prefix_chars"), chars("middle").alias("fim_middle_chars"), output.alias("fim_output"))
