"""Toxicity by the nearest labelled examples: exact TF-IDF cosine in block-max inverted lists, votes weighed by nearness.

1. Examples: at most EXAMPLES labelled documents that ``learn`` allows, the same ones on each run (smallest hash of id).
2. Features: terms that speak for toxic: LIFT times as often toxic as the examples are, in SEEN of them or more, and not by
   chance (log-likelihood ratio of at least LEAST); at most TERMS of them. Examples of one text count once here, as
   copies are no evidence of their own. Only features are ever broadcast, so that is bounded, too.
3. One pass over all documents keeps each one's features; document frequencies come from all of them.
4. An example is a unit vector, equal vectors are one example with its rows' mean label. Each document finds its NEAREST
   examples by the exact cosine, and their labels vote with the weight of the cosine to the POWER. All examples together
   have one vote more, of weight WHOLE, so that far neighbours prove little.
5. Votes become probabilities by isotonic regression over the examples, each judged without its own row.

Documents are scored one by one, so neither a frequent text nor a long one gathers rows in a task. A document's label is no
input of its score: an example that is scored itself doesn't vote.

Defined results: null is the empty text; a document without features is nearest to the examples without features, and
counts as if it were their like. Without examples all scores are 0. Null labels and null ids of labels teach nothing; of
several labels of one id the largest counts, and of several texts of one example the one with the smallest hash. A null id
isn't held out. Equal rows get equal scores; the order of ties among examples is that of their ids. Empty tables give no rows. Other
columns are left behind, whatever their names.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.blockmax import Lists, terms
from graphloom.llm.common import small_batches, stored, texts

#: Bounds of what is broadcast: labelled examples, and terms that are features.
EXAMPLES, TERMS = 1 << 13, 1 << 11
#: A feature's log-likelihood ratio (15.14: one in ten thousand by chance), examples, and share of toxic ones
#: as a multiple of the whole share, at least.
LEAST, SEEN, LIFT = 15.14, 4, 2.0
NEAREST, POWER, WHOLE = 31, 4.0, 0.1
#: Votes are counted in so many steps for the regression.
STEPS = 64
#: From here on a document is called toxic.
CALLED = 0.7
#: Results that a task remembers by features.
MEMO = 1 << 15


def held_out(ids: Column) -> Column:
    """Whether the id's CRC-32 leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(ids.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """id, text, label of at most ``most`` labelled documents that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("label"))
    known = known.filter("id IS NOT NULL AND label IS NOT NULL").filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    chosen = stored(known.orderBy(F.xxhash64("id"), "id").limit(most), "toxicity-labels")
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    return stored(own.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label")), "toxicity-examples")


def features(found: DataFrame, most: int = TERMS) -> list[bytes]:
    """The terms that tell labels apart, in order of bytes; at most ``most`` of them come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, label in zip(texts(b.column(0)), b.column(1).to_pylist(), strict=True):
                own = sorted({t for part in terms(data) for t in part})
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([label] * len(own), pa.int32())], ["term", "label"])

    found = found.dropDuplicates(["text"])
    total, toxic = found.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    counted = found.select("text", "label").mapInArrow(run, "term binary, label int").groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("t"))
    n, t = F.col("n"), F.col("t")

    def part(seen: Column, row: Column, column: float) -> Column:
        return F.when(seen > 0, seen * F.log(seen * float(total) / (row * column))).otherwise(0.0)

    clean = float(total - toxic)
    rest = F.lit(total) - n
    ratio = 2 * (part(t, n, float(toxic)) + part(n - t, n, clean) + part(F.lit(toxic) - t, rest, float(toxic)) + part(rest - (F.lit(toxic) - t), rest, clean))
    speaks = t * float(total) >= n * float(toxic) * LIFT
    best = counted.filter((n >= SEEN) & speaks).withColumn("ratio", ratio).filter(F.col("ratio") >= LEAST).orderBy(F.col("ratio").desc(), "term").limit(most)
    return sorted(bytes(r["term"]) for r in best.select("term").collect())


def counted(table: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """id, terms and tfs (features by number, as little-endian integers) from id and text."""
    shared = table.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for b in batches:
            own, tfs = [], []
            for data in texts(b.column(1)):
                hits: dict[bytes, int] = {}
                for part in terms(data):
                    for t in filter(number.__contains__, part):
                        hits[t] = hits.get(t, 0) + 1
                order = sorted(hits)
                own.append(np.array([number[t] for t in order], "<i4").tobytes())
                tfs.append(np.array([hits[t] for t in order], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.binary()), pa.array(tfs, pa.binary())], ["id", "terms", "tfs"])

    return table.select("id", "text").mapInArrow(run, "id long, terms binary, tfs binary")


def frequencies(vectors: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many documents each feature stands, and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(size, np.int64), 0
        for b in batches:
            rows += b.num_rows
            total += np.bincount(np.frombuffer(b"".join(texts(b.column(0))), "<i4"), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], ["term", "n"])

    found = dict(vectors.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect())  # TERMS rows and one
    return np.array([found.get(i, 0) for i in range(size)], float), found.get(-1, 0)


@dataclass
class Model:
    """Distinct example vectors: how many rows each stands for, how many of them are toxic, the smallest id; idf by feature."""

    idf: np.ndarray
    vectors: list[tuple[bytes, bytes]]
    rows: np.ndarray
    toxic: np.ndarray
    ids: list[int]
    own: dict[int, tuple[int, int]]  # id of an example: its vector, its label
    blank: int  # the vector without features, or -1
    places: list[float] = field(default_factory=list)  # votes, ascending, and the probabilities there
    levels: list[float] = field(default_factory=list)

    def unit(self, own: bytes, tfs: bytes) -> tuple[np.ndarray, np.ndarray]:
        at, tf = np.frombuffer(own, "<i4").astype(np.int64), np.frombuffer(tfs, "<i4")
        x = (1 + np.log(tf)) * self.idf[at]
        return at, x / math.sqrt(float(x @ x)) if len(x) else x

    def lists(self) -> Lists:
        units = [self.unit(*v) for v in self.vectors]
        at = np.concatenate([u[0] for u in units]) if units else np.empty(0, np.int64)
        x = np.concatenate([u[1] for u in units]) if units else np.empty(0)
        doc = np.repeat(np.arange(len(units)), [len(u[0]) for u in units])
        order = np.lexsort((doc, at))
        found, first = np.unique(at[order], return_index=True)
        return Lists(found, np.append(first, len(at)), doc[order], x[order], len(units))

    def vote(self, lists: Lists, own: bytes, tfs: bytes, skip: tuple[int, int] | None) -> tuple[float, list[int], list[float]]:
        """The share of votes for toxic, and the nearest examples with their cosines. skip: a vector of which one row (with
        its label) has no vote."""
        if own:
            near, cosines = lists.search(*self.unit(own, tfs), NEAREST + (skip is not None))
        elif self.blank >= 0:
            near, cosines = np.array([self.blank]), np.ones(1)
        else:
            near, cosines = np.empty(0, np.int64), np.empty(0)
        rows, toxic = self.rows[near], self.toxic[near]
        if skip is not None:
            same = near == skip[0]
            rows, toxic = rows - same, toxic - same * skip[1]
            near, cosines, toxic, rows = (x[rows > 0][:NEAREST] for x in (near, cosines, toxic, rows))
        weight = np.clip(cosines, 0, 1) ** POWER
        mean = self.toxic.sum() / max(1, self.rows.sum())
        share = float(((weight * toxic / rows).sum() + WHOLE * mean) / (weight.sum() + WHOLE))
        return share, [self.ids[i] for i in near], cosines.tolist()

    def probability(self, share: float) -> float:
        """The isotonic level of a vote, on a straight line between two levels."""
        return float(np.interp(share, self.places, self.levels)) if self.levels else share


def isotonic(values: list[float], rows: list[int], toxic: list[int]) -> tuple[list[float], list[float]]:
    """From counts by ascending value: the closest rising function, as the places where each of its levels begins and ends
    and the levels there."""
    blocks: list[list[float]] = []
    for v, n, t in zip(values, rows, toxic, strict=True):
        blocks.append([v, v, n, t])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, last, n1, t1 = blocks.pop()
            blocks[-1][1:] = [last, blocks[-1][2] + n1, blocks[-1][3] + t1]
    return [p for b in blocks for p in b[:2]], [b[3] / b[2] for b in blocks for _ in range(2)]


def _judged(vectors: DataFrame, model: Model) -> DataFrame:
    """id, share, near (ids of examples) and cosines."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    schema = "id long, share double, score double, near array<long>, cosines array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lists, memo = m.lists(), OrderedDict()
        for b in batches:
            rows = []
            for i, own, tfs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = (own, tfs, m.own.get(i))
                if key not in memo:
                    if len(memo) >= MEMO:
                        memo.popitem(last=False)
                    memo[key] = m.vote(lists, *key)
                share, near, cosines = memo[key]
                rows.append((i, share, m.probability(share), near, cosines))
            kinds = (pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()))
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "share", "score", "near", "cosines"])

    return vectors.select("id", "terms", "tfs").mapInArrow(run, schema)


def learned(spark: SparkSession, known: DataFrame, own: DataFrame, idf: np.ndarray) -> Model:
    """The model of the examples (id, label) with their vectors (id, terms, tfs)."""
    rows = own.join(known.select("id", "label"), "id").orderBy("id").collect()  # at most EXAMPLES rows of features
    place: dict[tuple[bytes, bytes], int] = {}
    counts, toxic, ids, by_id = [], [], [], {}
    for r in rows:
        key = bytes(r["terms"]), bytes(r["tfs"])
        if key not in place:
            place[key] = len(ids)
            counts.append(0)
            toxic.append(0)
            ids.append(r["id"])
        i = place[key]
        counts[i] += 1
        toxic[i] += r["label"]
        by_id[r["id"]] = (i, r["label"])
    model = Model(idf, list(place), np.array(counts, np.int64), np.array(toxic, np.int64), ids, by_id, place.get((b"", b""), -1))
    votes = _judged(own, model).join(known.select("id", "label"), "id")
    step = F.round(F.col("share") * STEPS)
    levels = votes.groupBy((step / STEPS).alias("v")).agg(F.count("*").alias("n"), F.sum("label").alias("t")).orderBy("v").collect()  # STEPS rows and one
    model.places, model.levels = isotonic(*zip(*levels, strict=True)) if levels else ([], [])
    return model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from CALLED on), near (ids of the examples that voted) and cosines.

    docs: doc_id, text. labels: doc_id, toxic (0 or 1).
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = examples(docs, labels)
    vocabulary = features(known)
    plain = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    vectors = stored(counted(plain, vocabulary), "toxicity-vectors")
    df, n = frequencies(vectors, len(vocabulary))
    model = learned(spark, known, stored(counted(known, vocabulary), "toxicity-own"), 1 + np.log((1 + n) / (1 + df)))
    found = _judged(vectors, model)
    called = (F.col("score") >= CALLED).cast("int")
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", called.alias("predicted"), "near", "cosines")
