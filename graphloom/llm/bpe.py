"""Byte-level BPE: encoding by a hierarchical-bitmap rank queue, and decoding.

A pre-token's adjacent pairs wait in one bucket for each merge rank. A two-level bitmap tells the lowest rank that
has an entry (find-first-set in the upper word, then in the lower one); a bucket is a heap of positions in a
linked list, so equal ranks merge from the left. Entries whose pair has changed meanwhile are stale and skipped.
A pre-token of n bytes takes O(n) queue operations, however long it is.

Defined results: a null or empty text has no tokens and decodes to no bytes; texts of any length, and single pre-tokens of
any length, are encoded whole; equal texts get equal ids, and repeated rows stay as they are; of pairs of one rank the
leftmost merges first; empty tables give no rows. Other columns pass through untouched, but those named like a new
column, in whatever case, are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphloom.llm.common import others, small_batches

#: Bits in a word of the rank bitmap's lower level.
WORD = 8
LOW = (1 << WORD) - 1
#: Pre-tokens that a worker remembers in each of two generations (about 120 MB in both; a worker keeps them after its task,
#: unless it is told not to).
#: Longer ones than MEMO_CHARS are not kept.
MEMO, MEMO_CHARS = 1 << 18, 48
#: Pre-tokens taken from a text at a time.
BLOCK = 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class _Memo(dict):
    """Packed ids of pre-tokens."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = self.encode(piece.encode())
            packed = pack(f"<{len(ids)}I", *ids) if len(ids) < 64 else np.asarray(ids, "<u4").tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def forget(self) -> None:
        self.clear()
        self.older = {}


class ByteBPE:
    """Encoder and decoder for one rank file and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.longest = max(map(len, ranks))
        self.leaf = [0] * ((max(ranks.values()) >> WORD) + 1)
        self.two = [-1] * 65536
        for token, rank in ranks.items():
            if len(token) == 2:
                self.two[token[0] << 8 | token[1]] = rank
        self.buckets: dict[int, int | list[int]] = {}
        self.bits = [1 << i for i in range(max(LOW + 1, len(self.leaf)))]
        self.memo = _Memo(self.encode_piece)
        self.tokens = {rank: token for token, rank in ranks.items()}

    def _push(self, rank: int, i: int) -> None:
        """Adds a position to a bucket that has some. A single position waits bare, as most do."""
        held = self.buckets[rank]
        if held.__class__ is int:
            self.buckets[rank] = [held, i] if held < i else [i, held]
        else:
            heappush(held, i)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        rank_of, longest = ranks.get, self.longest
        following, before, pair = list(range(1, n + 2)), list(range(-1, n + 1)), [-1] * (n + 1)
        leaf, buckets, top = self.leaf, self.buckets, 0
        two, bits, push = self.two, self.bits, self._push
        for i in range(n - 1):
            r = two[piece[i] << 8 | piece[i + 1]]
            if r >= 0:
                pair[i] = r
                if r in buckets:
                    push(r, i)
                else:
                    buckets[r] = i
                    leaf[r >> WORD] |= bits[r & LOW]
                    top |= bits[r >> WORD]
        while top:
            t = (top & -top).bit_length() - 1
            word = leaf[t]
            r = (t << WORD) | ((word & -word).bit_length() - 1)
            i = buckets[r]
            if i.__class__ is int:
                waiting = None
            else:
                waiting = i
                i = heappop(waiting)
            if not waiting:
                del buckets[r]
                leaf[t] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if pair[i] != r:
                continue
            j = following[i]
            following[i] = k = following[j]
            before[k] = i
            pair[i] = pair[j] = -1
            if k < n and (z := following[k]) - i <= longest and (r := rank_of(piece[i:z])) is not None:
                pair[i] = r
                if r in buckets:
                    push(r, i)
                else:
                    buckets[r] = i
                    leaf[r >> WORD] |= bits[r & LOW]
                    top |= bits[r >> WORD]
            if (i := before[i]) >= 0:
                pair[i] = -1
                if k - i <= longest and (r := rank_of(piece[i:k])) is not None:
                    pair[i] = r
                    if r in buckets:
                        push(r, i)
                    else:
                        buckets[r] = i
                        leaf[r >> WORD] |= bits[r & LOW]
                        top |= bits[r >> WORD]
        ids, i = [], 0
        while i < n:
            j = following[i]
            ids.append(ranks[piece[i:j]])
            i = j
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        known = self.memo.__getitem__
        if len(text) <= BLOCK:
            return b"".join(map(known, self.pattern.findall(text)))
        found, parts = (m[0] for m in self.pattern.finditer(text)), []
        while block := b"".join(map(known, islice(found, BLOCK))):
            parts.append(block)
        return b"".join(parts)

    def count(self, text: str) -> int:
        return len(self.encode(text)) // 4

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_loaded: dict[tuple[str, str], ByteBPE] = {}


def codec(path: str, pattern: str) -> ByteBPE:
    """The codec of a rank file, read once in each Python process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(read_ranks(path), pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", count: str = "n_tokens", keep: bool = True) -> DataFrame:
    """Replaces the column ``text`` by ``ids`` (binary, packed little-endian unsigned 32-bit) and ``count`` (long).

    path: a rank file that every executor can read. Columns of docs that have the new names are replaced. keep: whether
    workers remember pre-tokens beyond a task, which is faster; else their memory is free for what comes after.
    """
    small_batches(docs.sparkSession)
    rest = others(docs, text, ids, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in batches:
            packed = [bpe.encode(x or "") for x in b.column(b.schema.get_field_index(text)).to_pylist()]
            columns = [b.column(b.schema.get_field_index(f.name)) for f in rest]
            columns += [pa.array(packed, pa.binary()), pa.array([len(x) // 4 for x in packed], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in rest), ids, count])
        if not keep:
            bpe.memo.forget()

    schema = T.StructType([*rest, T.StructField(ids, T.BinaryType()), T.StructField(count, T.LongType())])
    return docs.select(*[f"`{f.name}`" for f in rest], f"`{text}`").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that ``ids`` stand for as binary column ``out``."""
    small_batches(encoded.sparkSession)
    rest = others(encoded, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in batches:
            plain = [bpe.decode(x or b"") for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in rest), pa.array(plain, pa.binary())], [*(f.name for f in rest), out])

    return encoded.select(*[f"`{f.name}`" for f in rest]).mapInArrow(run, T.StructType([*rest, T.StructField(out, T.BinaryType())]))
