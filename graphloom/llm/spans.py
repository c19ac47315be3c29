"""Spans of regular expressions in texts, by DataFrame functions only.

A pattern's matches are marked with a private-use character, the text is split there, and the lengths of the pieces
give the positions. Positions are running sums, taken by blocks of BLOCK in two levels, and what is cut out of a text is
taken from its chunks of CHUNK characters, so all of this takes time in proportion to the text and to its spans, however
many there are. The patterns must hold ASCII only and no groups by number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK, OTHER = "\ue000", "\ue001"
SPAN = "array<struct<kind:string,start:int,end:int,match:string>>"
#: Numbers of a block of running sums, and characters of a chunk.
BLOCK, CHUNK = 32, 256
#: Up to so many pieces or spans of a text a plain fold is faster than blocks and chunks; what it gives is the same.
FEW = 32

Binary = Callable[[Column, Column], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(numbers: Column, join: Binary) -> Column:
    """For each of an array's whole numbers, what join makes of 0 and the numbers before it (which is one number more than
    there are: the last is of all)."""
    zero, none = F.lit(0), F.array().cast("array<int>")

    def short(v: Column) -> Column:
        start = F.struct(zero.alias("at"), none.alias("out"))
        step = lambda s, x: F.struct(join(s["at"], x).cast("int").alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(v, start, step, lambda s: s["out"])

    def long(v: Column, above: Callable[[Column], Column]) -> Column:
        last = F.greatest(F.ceil(F.size(v) / BLOCK).cast("int") - 1, zero)
        blocks = F.transform(F.sequence(zero, last), lambda b: F.slice(v, b * BLOCK + 1, BLOCK))

        def spread(bs: Column) -> Column:
            whole = F.transform(bs, lambda b: F.aggregate(b, zero, lambda s, x: join(s, x).cast("int")))
            return let(above(whole), lambda offset: F.flatten(F.transform(bs, lambda b, i: F.transform(short(b), lambda x: join(F.get(offset, i), x).cast("int")))))

        return let(blocks, spread)

    padded = F.concat(numbers, F.array(zero))  # for the last
    return let(padded, lambda v: F.when(F.size(v) <= BLOCK, short(v)).otherwise(long(v, lambda sums: long(sums, short))))


def chunks(text: Column) -> Column:
    """The text in pieces of CHUNK characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """Characters start to end - 1 of a text in chunks()."""
    a, b = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
    inside = F.substring(piece(a), (start % CHUNK + 1).cast("int"), (end - start).cast("int"))
    head, tail = F.substring(piece(a), (start % CHUNK + 1).cast("int"), F.lit(CHUNK)), F.substring(piece(b), F.lit(1), (end % CHUNK).cast("int"))
    return F.when(end <= start, "").when(a == b, inside).otherwise(F.concat(head, F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), tail))


def spans(text: Column, pattern: str, kind: str, good: Callable[[Column], Column] | None = None, may: Column | None = None) -> Column:
    """Array of (kind, start, end, match): leftmost matches that don't overlap, in order; ends are exclusive.

    good: what a match must fulfil. may: a cheap condition without which no match can be.
    """
    clean = F.translate(text, MARK, OTHER)
    none = F.array().cast(SPAN)
    marked = F.split(F.regexp_replace(clean, f"(?:{pattern})", f"{MARK}$0{MARK}"), MARK, -1)

    def folded(pieces: Column) -> Column:
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), none.alias("found"))

        def step(state: Column, piece: Column) -> Column:
            upto = (state["at"] + F.char_length(piece)).cast("int")
            hit = F.struct(F.lit(kind).alias("kind"), state["at"].alias("start"), upto.alias("end"), piece.alias("match"))
            keep = (state["i"] % 2 == 1) & (good(piece) if good else F.lit(True))
            held = F.when(keep, F.concat(state["found"], F.array(hit))).otherwise(state["found"])
            return F.struct((state["i"] + 1).alias("i"), upto.alias("at"), held.alias("found"))

        return F.aggregate(pieces, start, step, lambda s: s["found"])

    def blocked(pieces: Column) -> Column:
        def hits(at: Column) -> Column:
            span = lambda p, i: F.struct(F.lit(kind).alias("kind"), F.get(at, i).alias("start"), F.get(at, i + 1).alias("end"), p.alias("match"))
            odd = F.filter(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, span(p, i))), Column.isNotNull)
            return F.filter(odd, lambda s: good(s["match"])) if good else odd

        return let(running(F.transform(pieces, F.char_length), lambda a, b: a + b), hits).cast(SPAN)

    there = text.rlike(pattern) if may is None else may & text.rlike(pattern)
    found = let(marked, lambda pieces: F.when(F.size(pieces) <= FEW, folded(pieces)).otherwise(blocked(pieces)))
    return F.coalesce(F.when(there, found), none)


def written(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _rewritten(text: Column, ordered: Column, piece: Callable[[Column, Column], Column]) -> Column:
    """The text with piece(span, upto) in place of each span; upto is where all spans before it end. ordered by start."""

    def folded() -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(state: Column, s: Column) -> Column:
            plain = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
            return F.struct(F.greatest(state["at"], s["end"]).cast("int").alias("at"), F.concat(state["out"], plain, piece(s, state["at"])).alias("out"))

        rest = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.lit(2147483647)))
        return F.aggregate(ordered, start, step, rest)

    def whole(parts: Column) -> Column:
        def joined(upto: Column) -> Column:
            each = F.transform(ordered, lambda s, i: F.concat(cut(parts, F.get(upto, i), s["start"]), piece(s, F.get(upto, i))))
            return F.concat(F.array_join(each, ""), cut(parts, F.get(upto, F.size(ordered)), F.char_length(text)))

        return let(running(F.transform(ordered, lambda s: s["end"]), F.greatest), joined)

    return F.when(F.size(ordered) == 0, text).when(F.size(ordered) <= FEW, folded()).otherwise(let(chunks(text), whole))


def replaced(text: Column, found: Column, mark: Callable[[Column], Column]) -> Column:
    """text with each run of overlapping spans replaced by mark(first span of the run)."""
    by_start = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"])
    return let(F.array_sort(found, by_start), lambda ordered: _rewritten(text, ordered, lambda s, upto: F.when(s["start"] >= upto, mark(s)).otherwise("")))


def blanked(text: Column, found: Column) -> Column:
    """text with spaces in place of the spans (sorted here), of the same length."""
    blank = lambda s, upto: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], upto), F.lit(0)))
    return let(F.array_sort(found, lambda a, b: a["start"] - b["start"]), lambda ordered: _rewritten(text, ordered, blank))
