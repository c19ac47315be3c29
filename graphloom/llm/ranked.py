"""Ranked lexical search: every document scored for every item, by inverted lists in blocks of variable length.

The items' distinct terms are taken in blocks of about PAIRS (item, term) pairs, so what is broadcast is bounded however
many items there are. For each such block the documents are read once: a task turns its documents into shards, one row
each, with the postings of the block's terms, and the shards are written. Counts over all of them give the terms' weights.
Then each shard's lists are cut into blocks by dynamic programming, each item is searched in it by block skipping
(``blockmax``), from the k-th best score of the shards that the task has seen already, and the tasks' short lists are
merged in two levels.

Defined results: a null text has no term; a document without terms counts in no statistic and isn't found; items without
terms find nothing. Rows of one item_id are one item with the terms of all of them; a null item_id is an item, too. Each
row of documents is a document, also where ids repeat; a null doc_id comes after the others of equal score. Texts of any
length are read whole, a part at a time. Empty tables give no rows; other columns are left behind, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.blockmax import Lists, terms
from graphloom.llm.common import small_batches, stored, texts

#: Pairs of an item and a term that are searched at a time, about; an item's own pairs stay together.
PAIRS = 1 << 18
#: Documents of a shard, and occurrences of terms after which it is full.
SHARD_DOCS, SHARD_TERMS = 1 << 15, 1 << 21
#: A document's occurrences beyond this are counted before they are kept.
LONG = 1 << 16
#: Groups in which the tasks' lists are merged first.
MERGES = 32
#: Fixed values of the score: see _impacts().
SCALE, TF, FLAT, SLOPE, STEP = 1_000_000_000, 1000, 10, 90, 8

INDEX = "ids array<bigint>, sizes array<bigint>, n_docs bigint, n_terms bigint, terms array<int>, counts array<int>, docs binary, tfs binary"


def item_terms(items: DataFrame, ids: str, text: str) -> DataFrame:
    """Distinct (item, term) of all items; an item without terms has a row with a null term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data in enumerate(texts(b.column(1))):
                found = sorted({t for part in terms(data) for t in part})
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(found), pa.int64())), pa.array(found, pa.binary())], ["item", "term"])

    plain = items.select(F.col(f"`{ids}`").alias("item"), F.col(f"`{text}`").alias("text"))
    kind = plain.schema["item"].dataType.simpleString()
    return plain.mapInArrow(run, f"item {kind}, term binary").distinct()


def _shard(ids: list, sizes: list[int], found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A row of the index. found: for each part, documents' numbers, terms and occurrences."""
    doc, term, tf = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(3))
    key = term * len(ids) + doc
    order = np.argsort(key, kind="stable")
    key, tf = key[order], tf[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    key, tf = key[at], np.add.reduceat(tf, at) if len(at) else tf
    unique, counts = np.unique(key // len(ids), return_counts=True)
    real = [s for s in sizes if s]
    values = [pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([len(real)]), pa.array([sum(real)], pa.int64())]
    values += [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (unique, counts)]
    values += [pa.array([x.astype("<i4").tobytes()]) for x in (key % len(ids), tf)]
    return pa.RecordBatch.from_arrays(values, [c.split()[0] for c in INDEX.split(", ")])


def index(docs: DataFrame, vocabulary: list[bytes], ids: str, text: str, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Shards of documents with the postings of the vocabulary's terms (by their numbers), a row each."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        keys: list = []
        sizes: list[int] = []
        found: list = []
        held = 0
        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                size, many = 0, []
                for part in terms(data):
                    size += len(part)
                    own = np.fromiter(map(number, part, repeat(-1)), np.int64, len(part))
                    many.append(own[own >= 0])
                own = np.concatenate(many) if many else np.empty(0, np.int64)
                tf = np.ones(len(own), np.int64)
                if len(own) > LONG:
                    own, tf = np.unique(own, return_counts=True)
                found.append((np.full(len(own), len(keys)), own, tf))
                keys.append(key)
                sizes.append(size)
                held += len(own)
                if len(keys) >= shard_docs or held >= SHARD_TERMS:
                    yield _shard(keys, sizes, found)
                    keys, sizes, found, held = [], [], [], 0
        if keys:
            yield _shard(keys, sizes, found)

    return docs.select(F.col(f"`{ids}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, INDEX)


def _impacts(tfs: np.ndarray, docs: np.ndarray, sizes: list[int], n: int, total: int) -> np.ndarray:
    """What a term with tf occurrences adds to the score of a document, for a weight of 1: (SCALE * tf) div (TF * tf + STEP * m),
    where m is FLAT + (SLOPE * size * n) div total."""
    m = np.array([FLAT + SLOPE * s * n // total for s in sizes], np.int64)
    tf = tfs.astype(np.int64)
    return SCALE * tf // (TF * tf + STEP * m[docs])


def _searcher(items: list[tuple[np.ndarray, np.ndarray]], n: int, total: int, k: int):
    """items: terms and weights of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, bool, int]]] = {}  # (-score, id is null, id), best first
        for b in batches:
            for row in b.to_pylist():
                docs, tfs = (np.frombuffer(row[c], "<i4") for c in ("docs", "tfs"))
                if not len(docs):
                    continue
                starts = np.concatenate([[0], np.cumsum(row["counts"])])
                keys = row["ids"]
                rank = np.array(sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] or 0)))  # numbers in order of ids
                number = np.empty(len(keys), np.int64)
                number[rank] = np.arange(len(keys))
                impacts = _impacts(tfs, docs, row["sizes"], n, total)
                by_list = np.argsort(np.repeat(np.arange(len(starts) - 1) * len(keys), np.diff(starts)) + number[docs], kind="stable")
                lists = Lists(np.array(row["terms"]), starts, number[docs][by_list], impacts[by_list], len(keys))
                for item, (own, weights) in enumerate(items):
                    held = best.get(item, [])
                    found, scores = lists.search(own, weights, k, -held[-1][0] if len(held) == k else 0)
                    if len(found):
                        more = [(-s, keys[rank[d]] is None, keys[rank[d]] or 0) for d, s in zip(found.tolist(), scores.tolist(), strict=True)]
                        best[item] = sorted(held + more)[:k]
        rows = [(item, None if null else key, -score) for item, held in best.items() for score, null, key in held]
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "doc_id", "score"])

    return run


def _block(docs: DataFrame, pairs: list, kind: str, k: int, ids: str, text: str, shard_docs: int) -> DataFrame:
    """The k best documents of a block of items."""
    spark = docs.sparkSession
    items: dict = {}
    for item, term in pairs:
        items.setdefault(item, []).append(bytes(term))
    vocabulary = sorted({t for own in items.values() for t in own})
    shards = stored(index(docs, vocabulary, ids, text, shard_docs), "ranked-shards")
    n, total = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    held = shards.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("df"))
    df = dict(held.collect())  # at most one row for each term of the block
    weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))]
    number = {t: i for i, t in enumerate(vocabulary)}
    told = []
    for own in items.values():
        at = np.array(sorted(number[t] for t in own if number[t] in df), np.int64)
        told.append((at, np.array([weight[i] for i in at], np.int64)))
    shared = spark.sparkContext.broadcast(told)
    search = lambda batches: _searcher(shared.value, n, total, k)(batches)
    found = shards.filter("size(terms) > 0").mapInArrow(search, "item int, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["item", F.pmod(F.xxhash64("doc_id"), F.lit(MERGES))], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(items)), f"item int, item_id {kind}")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, ids: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", shard_docs: int = SHARD_DOCS
) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's k highest-scoring documents (all with a score above 0, if
    fewer); ties to the smaller doc_id."""
    small_batches(docs.sparkSession)
    pairs = stored(item_terms(items, item, item_text), "ranked-items")
    blocks = max(1, -(-pairs.count() // PAIRS))
    parts = []
    for i in range(blocks):
        own = pairs.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i)
        parts.append(_block(docs, own.orderBy("item", "term").collect(), pairs.schema["item"].dataType.simpleString(), k, ids, text, shard_docs))
    return reduce(DataFrame.union, parts)
