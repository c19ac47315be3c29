"""Exact top-k search by tiled matrix products.

Queries and vectors are packed into tiles of fixed size. Each vector tile goes to one of ``shards`` groups, each query
tile to all of them, and an equi-join on the group brings them together: every pair of a query and a vector is scored
once, in a matrix product of two tiles. A task keeps the best k of each query so far, merging tile by tile, and a
final merge of the tasks' short lists picks the k best.

Defined results: vectors that are null, or hold null or non-finite components, take no part; a query meets only
vectors of its own dimension; with fewer than k candidates all are returned; equal scores go to the smaller id, and
repeated ids count as one query or candidate for each row they have; empty tables give no rows; other columns are left
behind, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import small_batches, stored

#: Rows of a tile of queries and of vectors, and query tiles whose short lists a task holds before it passes them on.
QUERY_TILE, VECTOR_TILE, HELD_TILES = 512, 4096, 64
EXACT = 2.0**53


def _pack(size: int, scale: float, ids: str, vector: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def tile(dim: int) -> pa.RecordBatch:
            parts = waiting.pop(dim)
            keys, rows = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([keys.astype("<i8").tobytes()]), pa.array([rows.astype("<f8").tobytes()]), pa.array([float(np.abs(rows).max(initial=0))])], ["dim", "ids", "rows", "top"])

        for b in batches:
            keys, lists = b.column(b.schema.get_field_index(ids)), b.column(b.schema.get_field_index(vector))
            sound = np.asarray(lists.is_valid()) & np.asarray(keys.is_valid())
            lengths = np.asarray(lists.value_lengths().fill_null(0))
            keys = np.asarray(keys.fill_null(0))
            for dim in np.unique(lengths[sound]):
                at = np.flatnonzero(sound & (lengths == dim))
                flat = lists.take(pa.array(at)).flatten()
                rows = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(len(at), dim)
                fine = np.isfinite(rows).all(axis=1)
                rows = np.floor(rows[fine] * scale) if scale else rows[fine]
                for i in range(0, len(rows), size):
                    waiting.setdefault(int(dim), []).append((keys[at][fine][i : i + size], rows[i : i + size]))
                    if sum(len(k) for k, _ in waiting[int(dim)]) >= size:
                        yield tile(int(dim))
        for dim in list(waiting):
            yield tile(dim)

    return run


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row: by score, then by smaller id."""
    if ids.shape[1] > k:
        part = np.argpartition(scores, -k, axis=1)[:, -k:]
        worst = np.take_along_axis(scores, part, 1).min(axis=1)
        for i in np.flatnonzero((scores >= worst[:, None]).sum(axis=1) > k):  # rows where ties cross the k-th place
            able = np.flatnonzero(scores[i] >= worst[i])
            part[i] = able[np.lexsort((ids[i, able], -scores[i, able]))[:k]]
        ids, scores = np.take_along_axis(ids, part, 1), np.take_along_axis(scores, part, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _score(k: int, skip_own: bool, whole: bool):
    low = -np.inf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def passed() -> Iterator[pa.RecordBatch]:
            for q, ids, scores in held.values():
                real = scores > low if scores.dtype.kind == "f" else np.ones(scores.shape, bool)
                kind = pa.int64() if whole else pa.float64()
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(q[:, None], ids.shape)[real]), pa.array(ids[real]), pa.array(scores[real].tolist(), kind)], ["query_id", "id", "score"])
            held.clear()

        for b in batches:
            for dim, q_ids, q_rows, q_top, v_ids, v_rows, v_top in zip(*(c.to_pylist() for c in b.columns), strict=True):
                q, v = np.frombuffer(q_ids, "<i8"), np.frombuffer(v_ids, "<i8")
                a, z = (np.frombuffer(x, "<f8").reshape(-1, dim) for x in (q_rows, v_rows))
                scores = a @ z.T
                if whole and q_top * v_top * dim >= EXACT:  # beyond what doubles hold exactly
                    scores = np.array([[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in z] for r in a], object).reshape(len(q), len(v))
                    scores = np.where(q[:, None] == v[None, :], -(1 << 200), scores) if skip_own else scores
                elif skip_own:
                    scores[q[:, None] == v[None, :]] = low
                ids = np.broadcast_to(v[None, :], scores.shape)
                if scores.dtype == object:
                    order = [sorted(range(len(v)), key=lambda j, i=i: (-scores[i, j], v[j]))[:k] for i in range(len(q))]
                    order = [[j for j in row if scores[i, j] > -(1 << 200)] for i, row in enumerate(order)]
                    for i, row in enumerate(order):
                        yield pa.RecordBatch.from_arrays([pa.array([int(q[i])] * len(row), pa.int64()), pa.array(v[row]), pa.array([int(scores[i, j]) for j in row], pa.int64())], ["query_id", "id", "score"])
                    continue
                ids, scores = _best(ids, scores, k)
                key = (dim, q_ids)
                if key in held:
                    _, ids0, scores0 = held[key]
                    ids, scores = _best(np.concatenate([ids0, ids], 1), np.concatenate([scores0, scores], 1), k)
                held[key] = (q, ids, scores)
                if len(held) >= HELD_TILES:
                    yield from passed()
        yield from passed()

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, scale: float = 0.0, ids: str = "vec_id", vector: str = "embedding", skip_own: bool = True) -> DataFrame:
    """query_id, rank (from 1), id, score of the k vectors with the largest inner product for each query.

    scale: if given, each component x becomes floor(scale * x) and scores are exact integers. skip_own: leave out
    candidates with the query's own id.
    """
    spark = queries.sparkSession
    small_batches(spark)
    schema = "dim int, ids binary, rows binary, top double"
    tiles = {}
    for name, table, size in (("q", queries, QUERY_TILE), ("v", vectors, VECTOR_TILE)):
        packed = table.select(F.col(f"`{ids}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vector")).mapInArrow(_pack(size, scale, "id", "vector"), schema)
        tiles[name] = stored(packed, f"topk-{name}").select("dim", *[F.col(c).alias(f"{name}_{c}") for c in ("ids", "rows", "top")])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, min(n, tiles["v"].count()))  # tiles, not rows
    split = max(1, n // shards)  # groups of query tiles, where there are fewer vector tiles than tasks
    q = tiles["q"].withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("part", F.abs(F.hash("q_ids")) % split)
    v = tiles["v"].withColumn("shard", (F.abs(F.hash("v_ids")) % shards)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(split - 1))))
    pairs = q.repartition(n, "dim", "shard", "part").join(v.repartition(n, "dim", "shard", "part"), ["dim", "shard", "part"])
    pairs = pairs.select("dim", "q_ids", "q_rows", "q_top", "v_ids", "v_rows", "v_top")
    lists = pairs.mapInArrow(_score(k, skip_own, bool(scale)), f"query_id long, id long, score {'long' if scale else 'double'}")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
