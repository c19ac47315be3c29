"""Ranked search, fill-in-the-middle and toxicity against plain Python, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import blockmax, fim, ranked, toxicity
from graphloom.llm import queries as q

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LINE = re.compile(r"[^\n]*\n|[^\n]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


# ---- lists in blocks


def test_terms_of_a_text_cut_anywhere(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abZ9 é日.\n😀") for _ in range(3000)) + "x" * 700 + " " + "é" * 400
    for chunk in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(blockmax, "CHUNK", chunk)
        assert [t.decode() for part in blockmax.terms(text.encode()) for t in part] == terms(text)


def test_cuts_have_the_least_error(monkeypatch):
    monkeypatch.setattr(blockmax, "LONGEST", 4)
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 30, 40)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    impacts = rng.integers(1, 1000, starts[-1])
    found = blockmax.cuts(impacts, starts)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        x = impacts[a:b].astype(float)
        fee = blockmax.FEE * x.mean()
        least = [0.0]
        for j in range(1, len(x) + 1):
            least.append(min(least[i] + fee + (j - i) * x[i:j].max() for i in range(max(0, j - 4), j)))
        own = [c for c in found if a <= c < b]
        assert own[0] == a
        cost = sum(fee + (d - c) * impacts[c:d].max() for c, d in zip(own, [*own[1:], b], strict=True))
        assert cost == pytest.approx(least[-1])


@pytest.mark.parametrize("kind", ["int", "huge", "float"])
def test_search_is_exact_and_skips(kind):
    rng = np.random.default_rng(3)
    n, many = 3000, 40
    lists = {t: np.sort(rng.choice(n, int(rng.integers(1, n // (1 + t % 9))), replace=False)) for t in range(0, 2 * many, 2)}
    top = {"int": 1000, "huge": 1 << 50, "float": 1000}[kind]
    values = {t: rng.integers(0, top, len(d)) if kind != "float" else rng.random(len(d)) for t, d in lists.items()}
    starts = np.concatenate([[0], np.cumsum([len(d) for d in lists.values()])])
    made = blockmax.Lists(np.array(list(lists)), starts, np.concatenate(list(lists.values())), np.concatenate(list(values.values())), n)
    assert (made.last - made.first >= 0).all() and (np.diff(made.at) <= blockmax.LONGEST).all()
    for k in (1, 10, n):
        asked = rng.choice(2 * many, 12, replace=False)
        weights = rng.integers(0, 9, 12) if kind != "float" else rng.random(12)
        scores = np.zeros(n, object if kind == "huge" else float if kind == "float" else np.int64)
        for t, w in zip(asked.tolist(), weights.tolist(), strict=True):
            if t in lists:
                scores[lists[t]] += w * values[t]
        wanted = sorted(range(n), key=lambda i: (-scores[i], i))
        wanted = [i for i in wanted if scores[i] > 0][:k]
        ids, found = made.search(asked, weights, k)
        if kind == "float":
            assert found == pytest.approx([scores[i] for i in wanted])
        else:
            assert ids.tolist() == wanted and found.tolist() == [scores[i] for i in wanted]
            bar = int(found[len(found) // 2])
            assert made.search(asked, weights, k, bar)[0].tolist() == [i for i in wanted if scores[i] >= bar]
    assert made.search(np.array([1, 999]), np.array([1, 1]), 3)[0].tolist() == []


# ---- ranked search


def best(docs, items, k=10):
    own = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in own]
    n, total = sum(1 for s in sizes if s), sum(sizes)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = set()
    for item, words in asked.items():
        found = []
        for row, ((i, c), size) in enumerate(zip(own, sizes, strict=True)):
            m = 10 + 90 * size * n // total if size else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in words if c[t])
            found += [(-score, i is None, i or 0, row)] if score > 0 else []
        out |= {(item, rank, None if null else i, -s) for rank, (s, null, i, _) in enumerate(sorted(found)[:k], 1)}
    return out


def test_op13(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    got = q.op13_ranked_search(spark, small)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == best(docs, items)


def test_ranked_edges(spark, monkeypatch):
    long = " ".join(f"w{i % 700}" for i in range(90_000))
    docs = [(5, "Cats AND dogs"), (4, "cats and dogs"), (4, "cats and dogs"), (None, "CATS and dogs"), (3, None), (2, ""), (1, "..."), (7, long), (9, "é日本 cats"), (8, "dogs " * 300)]
    items = [(1, "cats"), (1, "DOGS w5"), (2, None), (3, ""), (None, "and é日本"), (4, "nowhere"), (5, long)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"ID": F.lit(1), "Score": F.lit(2), "terms": F.lit("x"), "item": F.lit(0)}).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("TERM", F.lit(3))
    for pairs in (1 << 18, 300):  # all at once, and in blocks
        monkeypatch.setattr(ranked, "PAIRS", pairs)
        rows = [tuple(r) for r in ranked.search(frame, asked, k=4).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == best(docs, items, 4)
    assert ranked.search(frame.limit(0), asked).collect() == [] == ranked.search(frame, asked.limit(0)).collect()


def test_shards_of_few_documents(spark):
    """Many shards in a task: each search begins at the k-th best score so far."""
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30)))) for i in range(120)]
    items = [(i, " ".join(rng.sample("abcdefgh", 3))) for i in range(9)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    shards = ranked.index(frame, [c.encode() for c in "abcdefgh"], "doc_id", "text", shard_docs=7).collect()
    assert len(shards) == 18 and sum(r.n_docs for r in shards) == sum(1 for _, t in docs if t)
    rows = [tuple(r) for r in ranked.search(frame, spark.createDataFrame(items, "item_id long, text string"), k=5, shard_docs=7).collect()]
    assert set(rows) == best(docs, items, 5)


# ---- fill-in-the-middle


def middle(i, text, rate=100, spm=50):
    text = text or ""
    u = LINE.findall(text)
    x = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[8 * j : 8 * j + 8], 16) for j in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in fim.MARKS) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op12(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rows = {r.doc_id: tuple(r) for r in q.op12_fill_in_middle(spark, small).collect()}
    assert rows == {i: (i, *(w := middle(i, t))[:4], digest(w[4]), digest(t or "")) for i, t in docs}
    assert {r[2] for r in rows.values()} >= {"psm", "spm"}


def test_fim_edges(spark):
    texts = [None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "😀\n日本\n\né", "has <P> inside\nx", "x\n<M", "<S>", "<<S\n>\n<", "\r\n\x85 \n", "line\n" * 50_000, "a\nb"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "x\ny\nz\n"), (6, "a\nb")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"FIM_form": F.lit("old"), "units": F.lit(1), "fim input": F.lit(2), "N": F.lit(3)})
    got = fim.transform(frame, rate=60).withColumn("again", fim.restored(F.col("fim_output"), F.col("fim_form")))
    assert set(got.columns) == {"doc_id", "text", "units", "fim input", "N", "fim_units", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output", "again"}
    rows = got.select("doc_id", "text", "fim_units", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output", "again").collect()
    assert sorted((tuple(r) for r in rows), key=repr) == sorted(((i, t, *middle(i, t, rate=60), t or "") for i, t in docs), key=repr)
    assert fim.transform(frame.limit(0)).collect() == []


@pytest.mark.parametrize(("name", "pattern"), [("lines", r"[^\n]*\n|[^\n]+"), ("sentences", r"[^.!?]*[.!?]|[^.!?]+"), ("words", r"\s*\S+|\s+"), ("runs", r"[A-Za-z0-9]+|[^A-Za-z0-9]+")])
def test_units_of_each_grammar(spark, name, pattern):
    rng = random.Random(5)
    texts = ["", *("".join(rng.choice("ab1 .\n!é😀\t") for _ in range(rng.randint(1, 60))) for _ in range(80))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fim.units(F.col("t"), fim.GRAMMARS[name]).alias("u")).collect()
    assert all(r.u == re.findall(pattern, r.t, re.ASCII) for r in rows)


# ---- toxicity


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def test_op11_is_right_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    rows = q.op11_toxicity(spark, folder).collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    judged = [(r.score, toxic[r.doc_id]) for r in rows if r.held_out and toxic.get(r.doc_id) is not None]
    bad, good = [s for s, t in judged if t], [s for s, t in judged if not t]
    assert sum((b > g) + (b == g) / 2 for b in bad for g in good) / len(bad) / len(good) > 0.85
    assert sum(g >= 0.7 for g in good) <= 0.02 * len(good) and sum(b >= 0.7 for b in bad) >= 0.7 * len(bad)
    assert [tuple(r) for r in sorted(rows, key=lambda r: r.doc_id)] == [tuple(r) for r in sorted(q.op11_toxicity(spark, folder).collect(), key=lambda r: r.doc_id)]


def small_world(seed=6, n=400):
    rng = random.Random(seed)
    common, bad = [f"c{i}" for i in range(40)], ["vile", "foul", "rotten"]
    docs, labels = [], []
    for i in range(n):
        own = [rng.choice(common) for _ in range(rng.randint(0, 25))]
        label = int(rng.random() < 0.25)
        own += rng.choices(bad, k=rng.randint(1, 3)) if label else []
        rng.shuffle(own)
        docs.append((i, " ".join(own)))
        labels.append((i, 1, label))
    return docs, labels


def test_nearest_examples_by_the_exact_cosine(spark):
    docs, labels = small_world()
    d, x = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known = toxicity.examples(d, x)
    vocabulary = [t.decode() for t in toxicity.features(known)]
    assert {"vile", "foul", "rotten"} <= set(vocabulary)
    count = {i: Counter(t for t in terms(text) if t in vocabulary) for i, text in docs}
    df = Counter(t for c in count.values() for t in c)
    idf = {t: 1 + math.log((1 + len(docs)) / (1 + df[t])) for t in vocabulary}

    def unit(c):
        v = {t: (1 + math.log(n)) * idf[t] for t, n in c.items()}
        return {t: w / math.sqrt(sum(y * y for y in v.values())) for t, w in v.items()}

    distinct = {}
    for i, _, label in labels:
        if not held(i):
            rows = distinct.setdefault(tuple(sorted(count[i].items())), [[], []])
            rows[0].append(i)
            rows[1].append(label)
    for r in toxicity.score(d, x).collect():
        own = unit(count[r.doc_id])
        cosines = []
        for key, (ids, marks) in distinct.items():
            left = len(ids) - (r.doc_id in ids)
            share = (sum(marks) - sum(m for i, m in zip(ids, marks, strict=True) if i == r.doc_id)) / left if left else 0
            other = unit(dict(key))
            cosine = sum(w * other.get(t, 0) for t, w in own.items()) if own else float(not other)
            cosines += [(cosine, min(ids), share)] if left and cosine > 0 else []
        wanted = sorted((c for c, _, _ in cosines), reverse=True)[: toxicity.NEAREST]
        assert r.cosines == pytest.approx(wanted)
        assert {i: c for c, i, _ in cosines}[r.near[0]] == pytest.approx(wanted[0]) if wanted else r.near == []


def test_a_rising_function():
    assert toxicity.isotonic([0.0, 0.5, 1.0], [10, 10, 10], [1, 5, 9]) == ([0.0, 0.0, 0.5, 0.5, 1.0, 1.0], [0.1, 0.1, 0.5, 0.5, 0.9, 0.9])
    assert toxicity.isotonic([0.0, 0.5, 1.0], [10, 10, 10], [4, 2, 9]) == ([0.0, 0.5, 1.0, 1.0], [0.3, 0.3, 0.9, 0.9])


def test_toxicity_edges(spark):
    docs, labels = small_world(7, 200)
    extra = [(None, "vile"), (900, None), (901, ""), (902, "vile " * 60_000), (903, "😀 日本"), (3, docs[3][1]), (4, "another text of one id")]
    more = [(None, 1, 1), (900, 1, None), (3, 0, 0), (3, 0, 1), (5000, 1, 1)]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string").withColumns({"Label": F.lit(1), "toxic": F.lit(0), "ID": F.lit(9), "terms": F.lit("x")})
    x = spark.createDataFrame(labels + more, "doc_id long, quality int, toxic int").withColumn("TEXT", F.lit("z"))
    rows = toxicity.score(d, x).collect()
    assert len(rows) == len(docs) + len(extra) and all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r for r in rows if r.doc_id not in (3, 4)}
    assert by_id[900].score == by_id[901].score == by_id[903].score < 0.5 < by_id[902].score
    assert not by_id[None].held_out and by_id[None].score > 0.5
    assert {r.score for r in toxicity.score(d, x.limit(0)).collect()} == {0.0}
    assert toxicity.score(d.limit(0), x).collect() == []
