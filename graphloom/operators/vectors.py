"""Nearest reference entities of terms by cosine similarity.

Both sides are packed into tiles of unit vectors and dealt by an equi-join: each entity tile goes to one group, each term
tile to all, so that every term meets every entity once, in a product of two tiles. A task passes on the best of each tile
only, and a window ranks what is left. Nothing is collected or broadcast (the copies of the term tiles look small to the optimiser, so the join says that it
shuffles), and each side is read once.

stored_index() keeps the entities' side as tiles of vectors that lie near each other, each with its centroid and radius: a
search reads the tiles, not the vectors, and leaves products out that by these bounds can't reach the threshold or the k-th
best score so far. What it finds is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.durable import durable

TOP_K, THRESHOLD, OVER_FETCH = 5, 0.7, 3
#: Vectors in a tile of terms and of entities.
TERM_TILE, ENTITY_TILE = 512, 4096


def _unit(table: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return np.divide(table, length, out=np.zeros_like(table), where=length > 0)


def tiles(vectors: DataFrame, size: int) -> DataFrame:
    """From (id, v) tiles of one dimension each: dim, ids, rows (unit vectors as bytes). Vectors that are null or hold null
    or non-finite numbers are left out."""
    kind = vectors.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list]] = {}

        def tile(dim: int) -> pa.RecordBatch:
            ids, rows = waiting.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids], pa.list_(out)), pa.array([_unit(np.array(rows, float).reshape(len(ids), dim)).tobytes()])], ["dim", "ids", "rows"])

        for b in batches:
            out = b.schema.field(0).type
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is None or v is None or None in v or not np.isfinite(v).all():
                    continue
                ids, rows = waiting.setdefault(len(v), ([], []))
                ids.append(i)
                rows.append(v)
                if len(ids) >= size:
                    yield tile(len(v))
        for dim in list(waiting):
            yield tile(dim)

    return vectors.mapInArrow(run, T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("rows", T.BinaryType())]))


def _best(scores: np.ndarray, ids: list, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score (4 places) of each row's k best above the threshold; ties to the smaller id, so that no more
    than k go on however many are alike."""
    order = np.argsort(np.array(sorted(range(len(ids)), key=ids.__getitem__)))  # an id's place among all
    rounded = np.round(scores, 4)
    keep = scores > threshold
    if len(ids) > k:
        least = np.partition(rounded, -k, axis=1)[:, -k, None]
        keep &= rounded >= least
    i, j = np.nonzero(keep)
    chosen = np.lexsort((order[j], -rounded[i, j], i))
    i, j = i[chosen], j[chosen]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k], rounded[i, j][rank < k]


def nearest(terms: DataFrame, entities: DataFrame, k: int = TOP_K, threshold: float = THRESHOLD, term: str = "term", entity: str = "entity", vector: str = "embedding") -> DataFrame:
    """term, rank, entity, score: the k most similar entities with a score (4 places) above the threshold; ties to the
    smaller entity. Vectors that are null or hold null or non-finite numbers match nothing."""
    spark = terms.sparkSession
    kinds = [terms.schema[term].dataType, entities.schema[entity].dataType]
    packed = {}
    for name, table, key, size in (("t", terms, term, TERM_TILE), ("e", entities, entity, ENTITY_TILE)):
        plain = table.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
        packed[name] = durable(tiles(plain, size), "vector-tiles").select("dim", F.col("ids").alias(f"{name}_ids"), F.col("rows").alias(f"{name}_rows"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, min(n, packed["e"].count()))  # tiles, not rows
    dealt_t = packed["t"].withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt_e = packed["e"].withColumn("group", F.pmod(F.xxhash64("e_rows"), F.lit(groups)).cast("int"))
    pairs = dealt_t.join(dealt_e.hint("merge"), ["dim", "group"]).select("dim", "t_ids", "t_rows", "e_ids", "e_rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, other = (b.schema.field(i).type.value_type for i in (1, 3))
            for dim, t_ids, t_rows, e_ids, e_rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
                one, two = (np.frombuffer(x, float).reshape(-1, dim) for x in (t_rows, e_rows))
                i, j, best = _best(one @ two.T, e_ids, k, threshold)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array([t_ids[x] for x in i], own), pa.array([e_ids[x] for x in j], other), pa.array(best, pa.float64())], ["t", "e", "score"])

    found = pairs.mapInArrow(run, T.StructType([T.StructField("t", kinds[0]), T.StructField("e", kinds[1]), T.StructField("score", T.DoubleType())]))
    best = Window.partitionBy("t").orderBy(F.col("score").desc(), "e")
    rounded = found.withColumn("score", F.round("score", 4))
    return rounded.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(F.col("t").alias(term), "rank", F.col("e").alias(entity), "score")


def nearest_of_kind(terms: DataFrame, entities: DataFrame, accept: Column, k: int = TOP_K, threshold: float = THRESHOLD, **names: str) -> DataFrame:
    """OVER_FETCH * k nearest first, of these the k best that accept holds for: a far entity of the right kind isn't found."""
    entity = names.get("entity", "entity")
    term = names.get("term", "term")
    many = nearest(terms, entities, OVER_FETCH * k, threshold, **names)
    kinds = entities.filter(accept).select(F.col(entity).alias("kept_entity")).distinct()
    kept = many.join(kinds, many[entity] == kinds["kept_entity"], "left_semi")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(term).orderBy("rank"))).filter(F.col("rank") <= k)


#: Planes that sort vectors by their side of each: 2 to the power of this many groups at most.
PLANES = 6
INDEX = "dim int, ids {ids}, rows binary, centre binary, radius double"


def _sides(dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(dim)).standard_normal((dim, PLANES))


def build_index(entities: DataFrame, path: str, entity: str = "entity", vector: str = "embedding", size: int = ENTITY_TILE) -> None:
    """Writes an index of entities at path: tiles of vectors on the same sides of PLANES random planes."""

    @F.udf("int")
    def group(v):
        return None if v is None or None in v else int((np.array(v, float) @ _sides(len(v)) > 0) @ (1 << np.arange(PLANES)))

    plain = entities.select(F.col(f"`{entity}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    n = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = plain.withColumn("group", group("v")).repartitionByRange(n, "group", F.xxhash64("id")).sortWithinPartitions("group").select("id", "v")
    kind = plain.schema["id"].dataType.simpleString()

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            centres, radii = [], []
            for dim, rows in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = np.frombuffer(rows, float).reshape(-1, dim)
                centres.append(x.mean(axis=0).tobytes())
                radii.append(float(np.linalg.norm(x - x.mean(axis=0), axis=1).max()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(centres, pa.binary()), pa.array(radii)], ["dim", "ids", "rows", "centre", "radius"])

    tiles(near, size).mapInArrow(bounded, INDEX.format(ids=f"array<{kind}>")).write.mode("overwrite").parquet(path)


def stored_index(entities: DataFrame, path: str, **names: str) -> DataFrame:
    """The index at path, built there from entities if there is none. path is part of a content key: another path for other
    vectors. An index is there only when it has been written whole."""
    spark = entities.sparkSession
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        build_index(entities, path, **names)
        return spark.read.parquet(path)


def nearest_in(index: DataFrame, terms: DataFrame, k: int = TOP_K, threshold: float = THRESHOLD, term: str = "term", entity: str = "entity", vector: str = "embedding") -> DataFrame:
    """As nearest(), with the entities of an index."""
    spark = terms.sparkSession
    kinds = [terms.schema[term].dataType, index.schema["ids"].dataType.elementType]
    plain = terms.select(F.col(f"`{term}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    packed = durable(tiles(plain, TERM_TILE), "vector-tiles").select("dim", F.col("ids").alias("t_ids"), F.col("rows").alias("t_rows"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, min(n, index.count()))  # tiles, not rows
    dealt_t = packed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt_e = index.withColumn("group", F.pmod(F.xxhash64("centre", "ids"), F.lit(groups)).cast("int"))
    pairs = dealt_t.join(dealt_e.hint("merge"), ["dim", "group"]).select("dim", "t_ids", "t_rows", "ids", "rows", "centre", "radius")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}  # of a tile of terms: each one's k best scores so far
        for b in batches:
            own, other = (b.schema.field(i).type.value_type for i in (1, 3))
            for dim, t_ids, t_rows, ids, rows, centre, radius in zip(*(c.to_pylist() for c in b.columns), strict=True):
                one, two = (np.frombuffer(x, float).reshape(-1, dim) for x in (t_rows, rows))
                best = held.get(t_rows, np.full((len(one), k), -np.inf))
                bound = one @ np.frombuffer(centre, float) + radius + 1e-4
                able = np.flatnonzero((bound > threshold) & (bound >= best[:, 0]))
                if not len(able):
                    continue
                scores = one[able] @ two.T
                best[able] = np.partition(np.concatenate([best[able], scores], axis=1), -k, axis=1)[:, -k:]
                best[able] = np.sort(best[able], axis=1)
                held[t_rows] = best
                i, j, found = _best(scores, ids, k, threshold)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array([t_ids[able[x]] for x in i], own), pa.array([ids[x] for x in j], other), pa.array(found, pa.float64())], ["t", "e", "score"])

    found = pairs.mapInArrow(run, T.StructType([T.StructField("t", kinds[0]), T.StructField("e", kinds[1]), T.StructField("score", T.DoubleType())]))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("t").orderBy(F.col("score").desc(), "e")))
    return ranked.filter(F.col("rank") <= k).select(F.col("t").alias(term), "rank", F.col("e").alias(entity), "score")
