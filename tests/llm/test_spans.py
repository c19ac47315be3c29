"""Spans, running sums and cuts against plain Python, and that they take time in proportion to the text."""

from __future__ import annotations

import random
import re
import time
from itertools import accumulate

from pyspark.sql import functions as F

from graphloom.llm import pii, spans


def test_running_sums_and_maxima(spark):
    rng = random.Random(1)
    rows = [([rng.randint(0, 99) for _ in range(n)],) for n in (0, 1, 2, 31, 32, 33, 63, 64, 1023, 1024, 1025, 5000)]
    df = spark.createDataFrame(rows, "v array<int>")
    for r in df.select("v", spans.running(F.col("v"), lambda a, b: a + b).alias("s"), spans.running(F.col("v"), F.greatest).alias("m")).collect():
        assert r.s == list(accumulate(r.v, initial=0)) and r.m == list(accumulate(r.v, max, initial=0))


def test_cuts_of_a_text(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("ab\n é😀日") for _ in range(1500))
    pairs = [tuple(sorted((rng.randint(0, 1500), rng.randint(0, 1500)))) for _ in range(300)] + [(0, 0), (0, 1500), (256, 512), (255, 257), (1500, 1500), (1024, 1500)]
    df = spark.createDataFrame([(text, a, b) for a, b in pairs], "t string, a int, b int")
    for r in df.select("a", "b", spans.cut(spans.chunks(F.col("t")), F.col("a"), F.col("b")).alias("c")).collect():
        assert r.c == text[r.a : r.b]


def test_rewritten_texts(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        text = "".join(rng.choice("xyz é😀1 ") for _ in range(rng.choice((0, 5, 300, 900))))
        found = []
        for _ in range(rng.choice((0, 1, 3, 60))):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.randint(1, 40))
            found += [("k", a, b, text[a:b])] if a < b else []
        rows.append((i, text, found))
    df = spark.createDataFrame(rows, f"i int, t string, f {spans.SPAN}")
    mark = lambda s: F.concat(F.lit("<"), s["match"], F.lit(">"))
    got = df.select("t", "f", spans.blanked(F.col("t"), F.col("f")).alias("blank"), spans.replaced(F.col("t"), F.col("f"), mark).alias("new")).collect()
    for r in got:
        covered = {k for _, a, b, _ in r.f for k in range(a, b)}
        assert r.blank == "".join(" " if k in covered else c for k, c in enumerate(r.t))
        out, at = "", 0
        for _, a, b, match in sorted(r.f, key=lambda s: (s[1], -s[2])):
            out += r.t[at:a] + f"<{match}>" if a >= at else ""
            at = max(at, b)
        assert r.new == out + r.t[at:]


def test_time_in_proportion_to_the_matches(spark):
    """Ten times the matches in one text take at most twelve times as long (with what a job takes anyway)."""
    took = {}
    for n in (8_000, 80_000):
        text = " ".join(f"user{i}@mail{i % 97}.example.org says word{i}" for i in range(n))
        df = spark.createDataFrame([(text,)], "t string")
        base = df.select("t", pii.base_spans(F.col("t")).alias("b"))
        done = base.select(F.size("b").alias("n"), spans.blanked(F.col("t"), F.col("b")).alias("out"))
        began = time.perf_counter()
        row = done.first()
        took[n] = time.perf_counter() - began
        assert row.n == n == len(re.findall("@", text)) and len(row.out) == len(text) and "@" not in row.out
    assert took[80_000] <= 12 * took[8_000] + 2
