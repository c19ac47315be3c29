"""What several operators share: durable intermediate tables and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes in an Arrow batch: what a Python worker holds stays small, also where texts are long.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
#: Bytes of text that are hashed at a time.
CHUNK_BYTES = 4 << 20
#: Bits of a filter of ids: SPARE for each id, rounded up to a power of two, between the two bounds (a million 64-bit words are broadcast at most).
SPARE, LEAST_BITS, MOST_BITS = 64, 1 << 24, 1 << 26

_MASK = (1 << 64) - 1
_POWER = 0x9E3779B97F4A7C15
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches at BATCH_ROWS rows and about BATCH_BYTES bytes or fewer, or at one row."""
    for name, most in (("Records", BATCH_ROWS), ("Bytes", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.max{name}PerBatch"
        now = spark.conf.get(key).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The application's own folder below the one named in spark.checkpoint.dir; it can be deleted after the application.

    Where that is unset, a local session gets a temporary folder; on a cluster it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext.getCheckpointDir()
        if not found and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not found:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
            found = spark.sparkContext.getCheckpointDir()
        folder = found
    return f"{folder.rstrip('/')}/graphloom-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def others(df: DataFrame, *names: str) -> list[T.StructField]:
    """The fields of df but for those that have one of the names, in whatever case."""
    taken = {n.lower() for n in names}
    return [f for f in df.schema.fields if f.name.lower() not in taken]


def _fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, from the given ones."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def parted_by(df: DataFrame, ids: DataFrame, column: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows of df whose id may stand in ids (all that do, and few others), and the rest, without a shuffle of df.

    The ids are hashed into a bitmap of SPARE bits an id, which is broadcast in words of 64 bits; beyond MOST_BITS bits it
    grows no more, and more of df goes on. What follows has to be an exact join. A null id is among the rest.
    """
    word, found, at_, hits = _fresh(df, "filter_word", "filter_bits", "filter_at", "filter_hit")
    ids = stored(ids.select(F.xxhash64(F.col(f"`{column}`")).alias("hash")).distinct(), "id-hashes")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (SPARE * ids.count()).bit_length()))
    at = F.pmod("hash", F.lit(bits))
    one = lambda place: F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    bitmap = stored(ids.groupBy(F.floor(at / 64).alias(word)).agg(F.bit_or(one(at)).alias(found)), "id-bitmap")
    place = F.pmod(F.xxhash64(F.col(f"`{column}`")), F.lit(bits))
    marked = df.withColumn(at_, place).withColumn(word, F.floor(F.col(at_) / 64))
    hit = F.col(found).bitwiseAND(one(F.col(at_))) != 0
    met = marked.join(F.broadcast(bitmap), word, "left").withColumn(hits, F.coalesce(hit & F.col(f"`{column}`").isNotNull(), F.lit(False)))
    own = [F.col(f"`{c}`") for c in df.columns]
    return met.filter(F.col(hits)).select(*own), met.filter(~F.col(hits)).select(*own)


def perhaps_among(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """The first of the two parts of parted_by()."""
    return parted_by(df, ids, column)[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _powers(n: int, cache: list = [np.ones(1, np.uint64)]) -> np.ndarray:  # noqa: B006
    if len(cache[0]) < n:
        p = np.full(max(n, 4096), _POWER, np.uint64)
        p[0] = 1
        cache[0] = np.multiply.accumulate(p)
    return cache[0]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of one text: byte offsets and 64-bit hashes."""

    __slots__ = ("data", "starts", "ends", "hashes")

    def __init__(self, data: bytes):
        self.data = data
        raw = np.frombuffer(data, np.uint8)
        inside = np.empty(len(raw) + 2, np.int8)
        inside[0] = inside[-1] = 0
        inside[1:-1] = ~_SPACE[raw]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.hashes = _hash_words(raw, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]

    def span(self, i: int, j: int) -> list[bytes]:
        """Words i to j - 1."""
        return self.data[self.starts[i] : self.ends[j - 1]].split() if j > i else []


def _hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(starts, starts[at] + CHUNK_BYTES)))
        first, last = int(starts[at]), int(ends[upto - 1])
        lengths = ends[at:upto] - starts[at:upto]
        own = np.repeat(starts[at:upto] - first, lengths)
        total = int(lengths.sum())
        index = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        term = _BYTE[raw[first:last][own + index]] * _powers(int(lengths.max()))[index]
        out[at:upto] = np.add.reduceat(term, np.cumsum(lengths) - lengths)
        at = upto
    return mix(out)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words (none, if there are fewer), by a rolling polynomial."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(count, np.uint64)
    for i in range(n):
        acc = acc * np.uint64(_POWER) + hashes[i : i + count]
    return mix(acc)


def texts(column: pa.Array) -> Iterator[bytes]:
    """Each text as bytes; null as empty."""
    for x in column:
        yield x.as_buffer().to_pybytes() if x.is_valid else b""
