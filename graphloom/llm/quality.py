"""Quality rules as weak supervision: rules vote or abstain, and expectation-maximisation weighs their votes.

Each rule votes good (1), bad (-1) or abstains (0) on a document's counts. Documents are counted by vote pattern, of
which there are at most 3 to the power of the number of rules, so that table is small at any input size; it holds
all documents. Expectation-maximisation over it estimates, for the latent classes good and bad, how often each rule
votes how, and with that the posterior probability that a document of each pattern is good. Posteriors go back to
the documents by the pattern.

Defined results: a null or empty text has no words, fails the base rule and isn't kept; equal rows get equal verdicts;
texts of any length are counted whole; no documents give no rows; other columns pass through whatever their names,
those named qr_* are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import Words, small_batches, stored, texts, windows

COUNTS = ("qr_words", "qr_word_chars", "qr_symbols", "qr_dup_lines", "qr_repeat_words", "qr_lines", "qr_ended_lines", "qr_alpha_words", "qr_marked_words", "qr_letters")
SYMBOLS = b"#*$%&|<>"
ENDS = (b".", b"!", b"?", b'"', "”".encode(), "…".encode())

_CODES = np.arange(256)
#: ASCII letters and all bytes of other characters; characters that prose hardly has.
_LETTER = ((_CODES | 0x20) >= 0x61) & ((_CODES | 0x20) <= 0x7A) | (_CODES >= 0x80)
_MARK = np.isin(_CODES, list(SYMBOLS + b"{}[]\\/_=+~^@"))


def _counts(data: bytes) -> tuple[int, ...]:
    w = Words(data)
    n = len(w)
    if not n:
        return (0,) * len(COUNTS)
    word_chars = _points(data) - sum(data.count(bytes([c])) for c in (0x20, *range(0x09, 0x0E)))
    symbols = sum(data.count(bytes([c])) for c in SYMBOLS)
    seen: set[bytes] = set()
    lines = dup = ended = 0
    for line in data.split(b"\n"):
        bare = line.strip(b" \t\n\r\x0b\x0c")
        if not bare:
            continue
        lines += 1
        ended += bare.endswith(ENDS)
        dup += line in seen
        seen.add(line)
    repeat = 0
    if n >= 3:
        grams = windows(w.hashes, 3)
        _, inverse, times = np.unique(grams, return_inverse=True, return_counts=True)
        twice = times[inverse] > 1
        covered = np.zeros(n, bool)
        for i in range(3):
            covered[i : n - 2 + i] |= twice
        repeat = int(covered.sum())
    raw = np.frombuffer(data, np.uint8)
    alpha = int(np.logical_or.reduceat(_LETTER[raw], w.starts).sum())
    marked = int(np.logical_or.reduceat(_MARK[raw], w.starts).sum())
    return n, word_chars, symbols, dup, repeat, lines, ended, alpha, marked, int(np.count_nonzero(_LETTER[raw] & (raw < 0x80) | (raw >= 0xC0)))


def _points(data: bytes) -> int:
    """Code points: all bytes but continuation bytes."""
    return len(data) if data.isascii() else int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def measure(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with the counts in COUNTS (long); without the text, if it isn't to be kept."""
    small_batches(docs.sparkSession)
    rest = [f for f in docs.schema.fields if not f.name.lower().startswith("qr_") and (keep_text or f.name != text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_counts(x) for x in texts(b.column(b.schema.get_field_index(text)))]
            table = np.array(rows, np.int64).reshape(-1, len(COUNTS))
            columns = [b.column(b.schema.get_field_index(f.name)) for f in rest] + [pa.array(table[:, i]) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in rest), *COUNTS])

    return docs.select(*[f"`{f.name}`" for f in rest], *([] if keep_text else [f"`{text}`"])).mapInArrow(run, T.StructType([*rest, *(T.StructField(c, T.LongType()) for c in COUNTS)]))


def base_failed() -> Column:
    return (F.col("qr_words") < 50) | (100 * F.col("qr_repeat_words") > 50 * F.col("qr_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes by name. Every rule is a ratio of two counts, so length alone says little."""
    n, chars, lines = F.col("qr_words"), F.col("qr_word_chars"), F.col("qr_lines")
    some = n > 0
    mean = F.try_divide(chars, n)  # null without words, for which the other conditions decide
    return {
        "length": _vote(n < 50, n >= 80),
        "word_length": _vote(~some | (mean < 2.5) | (mean > 15), some & mean.between(3, 12)),
        "symbol_words": _vote(some & (F.col("qr_symbols") > 0.1 * n), some & (F.col("qr_symbols") <= 0.03 * n)),
        "symbol_chars": _vote(some & (F.col("qr_symbols") > 0.03 * chars), some & (F.col("qr_symbols") <= 0.01 * chars)),
        "marked_words": _vote(some & (F.col("qr_marked_words") > 0.2 * n), some & (F.col("qr_marked_words") <= 0.08 * n)),
        "letters": _vote(~some | (F.col("qr_letters") < 0.8 * chars), some & (F.col("qr_letters") >= 0.9 * chars)),
        "alpha_words": _vote(~some | (F.col("qr_alpha_words") < 0.8 * n), some & (F.col("qr_alpha_words") >= 0.9 * n)),
        "dup_lines": _vote((lines > 0) & (F.col("qr_dup_lines") > 0.5 * lines), (lines > 0) & (F.col("qr_dup_lines") <= 0.25 * lines)),
        "repeats": _vote(some & (F.col("qr_repeat_words") > 0.4 * n), some & (F.col("qr_repeat_words") <= 0.25 * n)),
        "ends": _vote((lines > 0) & (F.col("qr_ended_lines") < 0.12 * lines), (lines > 0) & (F.col("qr_ended_lines") >= 0.5 * lines)),
    }


#: How often a rule is taken to vote bad, abstain or vote good for each class, at the start and as prior counts.
START = {"bad": (0.45, 0.15, 0.40), "good": (0.03, 0.07, 0.90)}
PRIOR_ROWS, PRIOR_GOOD, ROUNDS = 20.0, 0.8, 60


def posteriors(patterns: list[tuple[tuple[int, ...], int]]) -> dict[tuple[int, ...], float]:
    """The probability of good for each vote pattern, from the patterns' frequencies, by expectation-maximisation."""
    if not patterns:
        return {}
    votes = np.array([p for p, _ in patterns]) + 1
    weight = np.array([c for _, c in patterns], float)
    m = votes.shape[1]
    start = np.array([START["bad"], START["good"]])
    table = np.repeat(start[:, None, :], m, axis=1)  # class, rule, vote
    share = PRIOR_GOOD
    for _ in range(ROUNDS):
        logs = np.log(table)
        score = logs[:, np.arange(m)[None, :], votes].sum(axis=2)
        odds = score[1] - score[0] + math.log(share / (1 - share))
        good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        mass = np.stack([(1 - good) * weight, good * weight])
        share = float((mass[1].sum() + PRIOR_ROWS * PRIOR_GOOD) / (weight.sum() + PRIOR_ROWS))
        for v in range(3):
            table[:, :, v] = mass @ (votes == v) + PRIOR_ROWS * start[:, None, v]
        table /= table.sum(axis=2, keepdims=True)
    return {p: float(g) for (p, _), g in zip(patterns, good, strict=True)}


def weigh(measured: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The columns of measure() with qr_base_failed, qr_posterior (null where the base rule fails) and qr_kept.

    measured is read twice, for the vote patterns and for the verdicts, and best stored before.
    """
    votes = F.concat(*[(v + 1).cast("string") for v in rules().values()])
    counted = measured.withColumn("qr_base_failed", base_failed()).withColumn("qr_votes", votes)
    light = stored(counted.filter("NOT qr_base_failed").groupBy(F.col("qr_votes").alias("v")).count(), "quality-votes")
    table = [(tuple(int(x) - 1 for x in r["v"]), r["count"]) for r in light.collect()]  # at most 3 ** rules rows
    names = {"".join(str(x + 1) for x in k): p for k, p in posteriors(sorted(table)).items()}
    if names:
        lookup = measured.sparkSession.createDataFrame(sorted(names.items()), "qr_votes string, qr_posterior double")
        counted = counted.join(F.broadcast(lookup), "qr_votes", "left")  # as few rows
    else:
        counted = counted.withColumn("qr_posterior", F.lit(None).cast("double"))
    posterior = F.when(~F.col("qr_base_failed"), F.col("qr_posterior"))
    good = F.coalesce(posterior >= threshold, F.lit(False))
    return counted.select(*[F.col(f"`{c}`") for c in measured.columns], "qr_base_failed", posterior.alias("qr_posterior"), good.alias("qr_kept"))


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5, keep_text: bool = True) -> DataFrame:
    """docs with COUNTS, qr_base_failed, qr_posterior and qr_kept. Texts are measured once."""
    return weigh(stored(measure(docs, text, keep_text), "quality-counts"), threshold)
