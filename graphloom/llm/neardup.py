"""MinHash near-duplicates with sequential Bayesian verification.

1. A text's set of word shingles gives a fingerprint, and HASHES minima. Texts with equal sets are one node from then on.
2. Bands of the signature make buckets. Each member of a bucket is paired with the bucket's smallest id, its pivot (a star).
3. A pair's signatures are compared batch by batch. With a uniform prior, m matches of n leave
   P(similarity >= threshold) = P(Binomial(n + 1, threshold) <= m); below the miss probability the pair is pruned.
4. Survivors are verified on their full sets, and links give components.
5. Where the members that share a pivot are of more than one component, those outside the largest meet all members of other
   components in blocks of BLOCK rows: signatures, then sets of 32-bit hashes are compared inside a task, and only pairs that
   withstand both become rows, for step 4. No candidate pair between different components stays untested, and none inside
   one is made.

Two texts of similarity s meet in a bucket with probability 1 - (1 - s ** ROWS) ** BANDS: 1 - 3e-6 at 0.8, more above.

Defined results: a null or empty text, or one without words, has no shingles and is linked with nothing; with fewer
words than a shingle has, the whole sequence is one shingle; repeated rows and ids are one node; a null id stays
alone; texts of any length are compared whole; no documents give no rows; other columns are left behind, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import Words, mix, perhaps_among, small_batches, stored, texts, windows
from graphloom.llm.components import components

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Signature positions compared at a time, and the miss probability of pruning.
BATCH, MISS = 16, 1e-6
#: Rows on either side of a block, and of its outer side compared at a time.
BLOCK, STRIP = 512, 16

_random = np.random.Generator(np.random.PCG64(7))
_A = _random.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingles(data: bytes, words: int) -> np.ndarray:
    """Distinct hashes of the lower-cased text's shingles, sorted."""
    h = Words(data.lower()).hashes
    return np.unique(windows(h, min(words, len(h)))) if len(h) else np.empty(0, np.uint64)


def signature(found: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 1024):
        low = np.minimum(low, (_A[:, None] * short[None, i : i + 1024] + _B[:, None]).min(axis=1))
    return low


def least_matches(threshold: float, miss: float) -> list[int]:
    """For n = BATCH, 2 * BATCH, ...: the fewest matches with which a pair goes on."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append(m)
    return out


def _features(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, prints, signatures = [], [], []
            for data in texts(b.column(1)):
                found = shingles(data, words)
                n.append(len(found))
                prints.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                signatures.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(signatures, pa.binary())], ["id", "n", "print", "sig"])

    kind = docs.schema["id"].dataType
    return docs.select("id", "text").mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("print", T.BinaryType()), T.StructField("sig", T.BinaryType())]))


def _banded(nodes: DataFrame) -> DataFrame:
    """A row for each node and band: key, id, n."""
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            keys = np.broadcast_to(salt, table.shape[:2]).copy()
            for i in range(ROWS):
                keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + table[:, :, i])
            take = pa.array(np.repeat(np.arange(len(table)), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), b.column(0).take(take), b.column(1).take(take)], ["key", "id", "n"])

    kind = nodes.schema["id"].dataType
    return nodes.select("id", "n", "sig").mapInArrow(run, T.StructType([T.StructField("key", T.LongType()), T.StructField("id", kind), T.StructField("n", T.LongType())]))


def _promising(pairs: DataFrame, nodes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) that sequential comparison of their signatures doesn't prune."""
    least = least_matches(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, HASHES) for i in (2, 3))
            alive, matches = np.arange(len(one)), np.zeros(len(one), np.int64)
            for k, m in enumerate(least):
                at = slice(k * BATCH, (k + 1) * BATCH)
                matches[alive] += (one[alive, at] == two[alive, at]).sum(axis=1)
                alive = alive[matches[alive] >= m]
                if not len(alive):
                    break
            take = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], ["a", "b"])

    sig = lambda side: nodes.select(F.col("id").alias(side), F.col("sig").alias(f"sig_{side}"))
    joined = pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b")
    return joined.mapInArrow(run, T.StructType([pairs.schema["a"], pairs.schema["b"]]))


def _verified(pairs: DataFrame, docs: DataFrame, words: int, hundredths: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= hundredths * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[object, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in batches:
            good = []
            for i, (key, one, two) in enumerate(zip(batch.column(0), texts(batch.column(2)), texts(batch.column(3)), strict=True)):
                if last[0] != key.as_py():
                    last = key.as_py(), shingles(one, words)
                other = shingles(two, words)
                common = len(np.intersect1d(last[1], other, assume_unique=True))
                if 100 * common >= hundredths * (len(last[1]) + len(other) - common):
                    good.append(i)
            take = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], ["u", "v"])

    needed = stored(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "near-needed")
    involved = stored(perhaps_among(docs.select("id", "text"), needed).join(needed, "id", "left_semi").dropDuplicates(["id"]), "near-texts")
    text = lambda side: involved.select(F.col("id").alias(side), F.col("text").alias(f"text_{side}"))
    joined = pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b")
    schema = T.StructType([T.StructField("u", pairs.schema["a"].dataType), T.StructField("v", pairs.schema["b"].dataType)])
    return joined.mapInArrow(run, schema)


def _profiles(ids: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """id, n, sig and short (the set as sorted 32-bit hashes) of the given ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            short = [np.unique((shingles(x, words) >> np.uint64(32)).astype(np.uint32)).tobytes() for x in texts(b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(short, pa.binary())], ["id", "n", "sig", "short"])

    involved = perhaps_among(docs, ids).join(ids, "id", "left_semi").dropDuplicates(["id"]).join(perhaps_among(nodes, ids), "id")
    return involved.select("id", "n", "sig", "text").mapInArrow(run, T.StructType([*nodes.schema.fields, T.StructField("short", T.BinaryType())]))


def _compared(outer: list, inner: list, least: list[int], hundredths: int) -> list[tuple]:
    """Pairs of a block's sides that are of different components and withstand all tests.

    A row: id, n, component, whether it is of the largest component, signature, set.
    """
    found = []
    n_in, c_in, main_in = np.array([r[1] for r in inner]), np.array([r[2] for r in inner]), np.array([r[3] for r in inner])
    ids_in = np.array([r[0] for r in inner])
    sig_in = np.frombuffer(b"".join([r[4] for r in inner]), np.uint32).reshape(-1, HASHES)
    for at in range(0, len(outer), STRIP):
        strip = outer[at : at + STRIP]
        n, c, ids = (np.array([r[k] for r in strip])[:, None] for k in (1, 2, 0))
        sig = np.frombuffer(b"".join([r[4] for r in strip]), np.uint32).reshape(-1, HASHES)
        fit = (c != c_in) & (main_in | (ids < ids_in)) & (100 * np.minimum(n, n_in) >= hundredths * np.maximum(n, n_in))
        i, j = np.nonzero(fit)
        matches = np.zeros(len(i), np.int64)
        for k, m in enumerate(least):
            part = slice(k * BATCH, (k + 1) * BATCH)
            matches += (sig[i, part] == sig_in[j, part]).sum(axis=1)
            alive = matches >= m
            i, j, matches = i[alive], j[alive], matches[alive]
            if not len(i):
                break
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            one, two = np.frombuffer(strip[x][5], np.uint32), np.frombuffer(inner[y][5], np.uint32)
            # shared shingles can have lost no more hashes to coincidences than either set has in all
            lost = min(strip[x][1] - len(one), inner[y][1] - len(two))
            common = len(np.intersect1d(one, two, assume_unique=True)) + lost
            if 100 * common >= hundredths * (strip[x][1] + inner[y][1] - common):
                found.append((strip[x][0], inner[y][0]))
    return found


def _across(placed: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, hundredths: int, miss: float) -> DataFrame:
    """From placed (pivot, id, component): pairs (a, b) of different components that share a pivot and withstand comparison."""
    least = least_matches(hundredths / 100, miss)
    sizes = placed.groupBy("pivot", "component").agg(F.count(F.lit(1)).alias("size"))
    mixed = sizes.groupBy("pivot").agg(F.max(F.struct("size", "component")).alias("main"), F.sum("size").alias("total"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    mixed = stored(mixed.select("pivot", F.col("main.component").alias("main"), F.ceil(F.col("total") / BLOCK).cast("int").alias("n_in"), F.ceil((F.col("total") - F.col("main.size")) / BLOCK).cast("int").alias("n_out")), "near-mixed")
    rows = placed.join(mixed, "pivot").withColumn("is_main", F.col("component") == F.col("main"))
    rows = stored(rows.select("pivot", "id", "component", "is_main", "n_in", "n_out"), "near-rows")
    tile = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = rows.filter(~F.col("is_main")).select("*", F.lit(True).alias("is_outer"), tile("n_out").alias("x")).select("*", every("n_in").alias("y"))
    inner = rows.select("*", F.lit(False).alias("is_outer"), tile("n_in").alias("y")).select("*", every("n_out").alias("x"))
    wanted = stored(rows.select("id").distinct(), "near-wanted")
    profiles = stored(_profiles(wanted, nodes, docs, words), "near-profiles")
    dealt = outer.unionByName(inner).select("pivot", "x", "y", "is_outer", "id", "component", "is_main").join(profiles, "id")
    dealt = dealt.repartition("pivot", "x", "y").sortWithinPartitions("pivot", "x", "y")
    columns = ["pivot", "x", "y", "is_outer", "id", "n", "component", "is_main", "sig", "short"]
    kind = nodes.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, {True: [], False: []}

        def compare() -> Iterator[pa.RecordBatch]:
            pairs = _compared(sides[True], sides[False], least, hundredths) if sides[True] and sides[False] else []
            if pairs:
                a, b = zip(*[(min(p), max(p)) for p in pairs], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for pivot, x, y, is_outer, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (pivot, x, y) != now:
                    yield from compare()
                    now, sides = (pivot, x, y), {True: [], False: []}
                sides[is_outer].append(row)
        yield from compare()

    return dealt.select(*columns).mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)])).distinct()


def _close(n: Column, m: Column, hundredths: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * hundredths


def near_duplicates(docs: DataFrame, words: int = 5, hundredths: int = 80, miss: float = MISS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links lead to, its own included) and kept.

    words: of a shingle. hundredths: the least similarity in hundredths. miss: probability of pruning a true link.
    """
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    features = stored(_features(plain, words), "near-features")
    sound = F.col("id").isNotNull() & F.col("print").isNotNull()
    sets = stored(features.filter(sound).groupBy("print").agg(F.min("id").alias("node")), "near-sets")
    single = sets.groupBy(F.col("node").alias("id")).agg(F.min("print").alias("print"))  # an id of several texts is one node
    fewest = -(-hundredths // max(1, 100 - hundredths))  # smaller sets are linked with equal ones only
    chosen = features.filter(sound & (F.col("n") >= fewest)).join(single, ["id", "print"], "left_semi")
    nodes = stored(chosen.dropDuplicates(["id", "print"]).select("id", "n", "sig"), "near-nodes")

    banded = _banded(nodes)
    buckets = stored(banded.groupBy("key").agg(F.min(F.struct("id", "n")).alias("pivot"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("key", "pivot"), "near-buckets")
    met = banded.join(buckets, "key").filter(F.col("id") != F.col("pivot.id")).select(F.col("pivot.id").alias("pivot"), F.col("pivot.n").alias("pivot_n"), "id", "n")
    met = stored(met.distinct(), "near-stars")
    busy = met.select("id").union(met.select(F.col("pivot").alias("id")))
    nodes = stored(perhaps_among(nodes, busy), "near-busy")
    stars = met.filter(_close(F.col("n"), F.col("pivot_n"), hundredths)).select(F.col("pivot").alias("a"), F.col("id").alias("b"))

    survivors = stored(_promising(stars, nodes, hundredths / 100, miss), "near-survivors")
    found = stored(_verified(survivors, plain, words, hundredths), "near-links")
    grouped = components(found)
    placed = stored(met.select("pivot", "id").join(grouped, "id", "left").withColumn("component", F.coalesce("component", "id")), "near-placed")
    across = stored(_across(placed, nodes, plain, words, hundredths, miss), "near-across")
    if not across.isEmpty():
        grouped = components(found.union(_verified(across, plain, words, hundredths)))

    own = sets.join(grouped.withColumnRenamed("id", "node"), "node", "left").select("print", F.coalesce("component", "node").alias("component"))
    out = features.select("id", "n", F.when(sound, F.col("print")).alias("print")).join(own, "print", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
