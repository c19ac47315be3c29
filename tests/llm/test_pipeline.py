"""Each stage of the pipeline on its own input against plain Python, and run() against the stages one by one."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from graphloom.llm import quality
from tests.llm import brute


@pytest.fixture(scope="module")
def states(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.stored(stage(spark, out[-1], small), "state"))
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality(spark, small, states):
    kept = {r.doc_id for r in quality.judge(states[0]).filter("qr_kept").collect()}
    assert set(by_id(states[1])) == kept
    failed = {i for i, r in by_id(states[0]).items() if brute.rule_counts(r.text)[5]}
    assert kept and not kept & failed
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    good = {i for i, q in labels.items() if q == 1} - failed
    bad = {i for i, q in labels.items() if q == 0}
    assert len(good & kept) >= 0.97 * len(good) and len(bad & kept) <= 0.1 * max(1, len(bad))


def test_near_dedup(states):
    wanted = {i for i, _, _, kept in brute.near_duplicates([(i, r.text) for i, r in by_id(states[1]).items()], n=5) if kept}
    assert set(by_id(states[2])) == wanted and states[2].count() == len(wanted)


def test_personal_data(states):
    before, after = by_id(states[2]), by_id(states[3])
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert r.n_chars == len(r.text) and not [k for k, _, _ in brute.pii(r.text) if k in ("email", "card")]
        if not brute.pii(before[i].text):
            assert r.text == before[i].text


def test_mixing(states):
    before = by_id(states[3])
    copies = Counter(r.doc_id for r in states[4].collect())
    totals, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, r in before.items():
        n = len(brute.words(r.text))
        totals[r.source] += n
        taken[r.source] += n * copies[i]
        largest[r.source] = max(largest[r.source], n)
    wanted = brute.level_targets(dict(totals))
    assert max(copies.values()) <= 3
    assert all(abs(taken[s] - wanted[s]) <= largest[s] for s in totals)


def test_tokens(states):
    enc, texts = brute.encoder(), by_id(states[4])
    rows = states[5].collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in states[4].collect())
    for r in rows:
        ids = list(memoryview(bytes(r.token_ids)).cast("I"))
        assert ids == enc.encode_ordinary(texts[r.doc_id].text) and r.n_tokens == len(ids)


def test_run(spark, small, states):
    key = lambda r: (r.doc_id, r.n_tokens, bytes(r.token_ids))
    assert Counter(map(key, corpus_pipeline.run(spark, small).collect())) == Counter(map(key, states[5].collect()))


def test_marks_are_plain(states):
    """The private-use characters that spans are marked with inside don't stay in a text."""
    assert not any("\ue000" in r.text or "\ue001" in r.text for r in states[3].collect())
