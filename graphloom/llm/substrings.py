"""Removal of word sequences that an earlier document has too, by suffix automata of reference passages.

A window is WINDOW consecutive words. Matching every document against automata of the whole corpus would cost the square
of its size, so fingerprints first choose the shards of reference text that each document needs; automata then decide.

1. Each window's smallest hash of ANCHOR words is its anchor, the same wherever the window stands. Neighbouring windows
   with one anchor form a run, known by its anchor and the hash of all its words.
2. Of the runs whose anchor stands in more than one document, an equal run in an earlier document settles all windows of
   a run at once. Where an anchor has several different runs, the first document of each passes on its window hashes,
   and equal ones lead to the earliest document.
3. The stretches of all these runs are cut out as pieces (PASSAGE runs at most, whole windows). Equal hashes lead each
   piece to the earliest one that shares a run or a window with it, its reference.
4. References are dealt by hash to shards of about SHARD_BYTES, neighbours together. Of each shard one suffix automaton
   is built, whose states know the smallest id they stand in; the pieces that need the shard are streamed through it.
   Where the matching statistic reaches WINDOW words of a smaller id, those words are marked; marked spans go.
   A shard with many pieces is matched in several parts of about PART pieces, each with a copy of the shard.

Nothing is pairwise: a passage of a million documents is met by each of them through its first document only. All
groupings are minima that combine before a shuffle.

Defined results: a null or empty text has no words; texts shorter than a window lose nothing; rows with equal ids are
one document's and don't count against each other; a null id is neither earlier nor later than any; texts of any length
are read whole; no documents give no rows; other columns are left behind, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import Words, mix, parted_by, perhaps_among, small_batches, stored, texts, windows

WINDOW, ANCHOR = 50, 8
#: Windows in a run, and runs in a piece, at most.
RUN, PASSAGE = 64, 16
#: Bytes of references in a shard, on average; pieces of one text that are neighbours in a shard; pieces in a part of a shard.
SHARD_BYTES, NEIGHBOURS, PART = 256 << 10, 8, 4096

_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006
    if len(cache.get(base, ())) < max(n, 1):
        p = np.full(max(n, 1 << 14), base, np.uint64)
        p[0] = 1
        cache[base] = np.multiply.accumulate(p)
    return cache[base]


class Runs:
    """The runs of one text: first window, windows, anchor and hash of each."""

    def __init__(self, hashes: np.ndarray, window: int):
        n, self.window = len(hashes), window
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * _powers(_P, n)[:n], out=self.sums[1:])
        m = n - window + 1
        if m <= 0:
            self.first = self.count = np.empty(0, np.int64)
            self.anchor = self.key = np.empty(0, np.uint64)
            return
        anchor = min(ANCHOR, window)
        low, width, wanted = windows(hashes, anchor), 1, window - anchor + 1
        while 2 * width <= wanted:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < wanted:
            low = np.minimum(low[: m], low[wanted - width : wanted - width + m])
        change = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        length = np.diff(np.append(change, m))
        pieces = -(-length // RUN)
        inner = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.first = np.repeat(change, pieces) + inner * RUN
        self.count = np.minimum(np.repeat(change + length, pieces) - self.first, RUN)
        self.anchor = low[self.first]
        self.key = self.hashed(self.first, self.count + window - 1)

    def hashed(self, start: np.ndarray, words: np.ndarray | int) -> np.ndarray:
        raw = (self.sums[start + words] - self.sums[start]) * _powers(_INVERSE, len(self.sums))[start]
        return mix(raw + np.uint64(0x51ED270B2F1B7C4D) * np.asarray(words, np.uint64))

    def window_hashes(self, i: int) -> np.ndarray:
        return self.hashed(np.arange(self.first[i], self.first[i] + self.count[i]), self.window)


class SuffixAutomaton:
    """Of passages of words. Each state knows the smallest id among the passages it stands in."""

    def __init__(self, passages: list[tuple[object, list[bytes]]]):
        self.next: list[dict] = [{}]
        self.link, self.length, self.least = [-1], [0], [None]
        last = 0
        for mark, (key, words) in enumerate(passages):
            for word in (*words, mark):  # a number parts the passages; no word equals it
                last = self._add(last, word, key)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.link[v]
            if self.least[up] is None or self.least[v] < self.least[up]:
                self.least[up] = self.least[v]

    def _add(self, last: int, word, key) -> int:
        following, link, length = self.next, self.link, self.length
        new = len(link)
        following.append({})
        length.append(length[last] + 1)
        self.least.append(key)
        link.append(0)
        p = last
        while p >= 0 and word not in following[p]:
            following[p][word] = new
            p = link[p]
        if p >= 0:
            q = following[p][word]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(link)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                self.least.append(self.least[q])
                while p >= 0 and following[p].get(word) == q:
                    following[p][word] = clone
                    p = link[p]
                link[q] = link[new] = clone
        return new

    def marked(self, words: list[bytes], key, window: int) -> np.ndarray:
        """Which words lie in a window that stands in a passage of a smaller id."""
        following, link, length, least = self.next, self.link, self.length, self.least
        ends = []
        v = reach = 0
        for i, word in enumerate(words):
            while v and word not in following[v]:
                v = link[v]
                reach = length[v]
            v = following[v].get(word, -1)
            if v < 0:
                v = reach = 0
                continue
            reach += 1
            if reach >= window:
                while length[link[v]] >= window:
                    v = link[v]
                reach = min(reach, length[v])
                if least[v] < key:
                    ends.append(i)
        edge = np.zeros(len(words) + 1, np.int64)
        at = np.array(ends, np.int64)
        np.add.at(edge, at - window + 1, 1)
        np.add.at(edge, at + 1, -1)
        return np.cumsum(edge)[:-1] > 0


def _runs(docs: DataFrame, window: int) -> DataFrame:
    """id, anchor, run of each document's runs, equal ones once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, pairs = [], []
            for i, data in enumerate(texts(b.column(1))):
                found = Runs(Words(data).hashes, window)
                _, at = np.unique(found.key, return_index=True)
                take.append(np.full(len(at), i))
                pairs.append((found.anchor[at], found.key[at]))
            if pairs:
                anchors, keys = (np.concatenate([p[k] for p in pairs]).view(np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(take))), pa.array(anchors), pa.array(keys)], ["id", "anchor", "run"])

    return docs.mapInArrow(run, T.StructType([docs.schema["id"], T.StructField("anchor", T.LongType()), T.StructField("run", T.LongType())]))


def _pieces(wanted: DataFrame, window: int) -> DataFrame:
    """From id, row, text, settled and open (arrays of runs): the stretches of a text that the runs cover, cut into
    pieces of PASSAGE runs at most. A piece is a row with its text and first word, and a row for each hash that it is
    found by: those of settled runs, and of the windows of open ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, no, hashes, starts, texts_ = [], [], [], [], []
            for i, (data, settled, opened) in enumerate(zip(texts(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                words = Words(data)
                found = Runs(words.hashes, window)
                keys = found.key.view(np.int64)
                in_settled, in_open = (np.isin(keys, np.array(k or [], np.int64)) for k in (settled, opened))
                at = np.flatnonzero(in_settled | in_open)
                if not len(at):
                    continue
                fresh = np.concatenate([[True], np.diff(at) != 1])
                place = np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                fresh |= place % PASSAGE == 0
                piece = np.cumsum(fresh) - 1
                first = np.flatnonzero(fresh)
                last = np.append(first[1:], len(at)) - 1
                begin, end = found.first[at[first]], found.first[at[last]] + found.count[at[last]] + window - 1
                passages = [words.data[words.starts[x] : words.ends[y - 1]] for x, y in zip(begin, end, strict=True)]
                runs, spread = at[in_settled[at]], at[in_open[at]]
                many = found.count[spread]
                inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                by_window = found.hashed(np.repeat(found.first[spread], many) + inner, window).view(np.int64)
                numbers = (np.arange(len(first)), piece[in_settled[at]], np.repeat(piece[in_open[at]], many))
                known = np.concatenate([keys[runs], by_window])
                take.append(np.full(len(first) + len(known), i))
                no.append(np.concatenate(numbers))
                hashes.append(pa.concat_arrays([pa.nulls(len(first), pa.int64()), pa.array(known)]))
                starts.append(pa.concat_arrays([pa.array(begin.astype(np.int64)), pa.nulls(len(known), pa.int64())]))
                texts_.append(pa.concat_arrays([pa.array(passages, pa.binary()), pa.nulls(len(known), pa.binary())]))
            if take:
                rows = pa.array(np.concatenate(take))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), pa.array(np.concatenate(no).astype(np.int32)), pa.concat_arrays(hashes), pa.concat_arrays(starts), pa.concat_arrays(texts_)],
                    ["id", "row", "no", "hash", "start", "passage"],
                )

    schema = T.StructType([wanted.schema["id"], wanted.schema["row"], T.StructField("no", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("start", T.LongType()), T.StructField("passage", T.BinaryType())])
    return wanted.select("id", "row", "text", "settled", "open").mapInArrow(run, schema)


def _dealt(docs: DataFrame, window: int) -> DataFrame:
    """Shards of reference pieces and the pieces of documents to be matched with each: shard, part, queried, id, row,
    start, passage. A shard's references stand in each of its parts."""
    runs = stored(_runs(docs.select("id", "text"), window), "sub-runs")
    shared = runs.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("anchor")
    runs = stored(runs.join(shared, "anchor", "left_semi"), "sub-shared")
    firsts = stored(runs.groupBy("anchor", "run").agg(F.min("id").alias("first"), F.max("id").alias("last")), "sub-firsts")
    settled = runs.join(firsts.filter("first < last").select("anchor", "run"), ["anchor", "run"]).select("id", F.col("run").alias("settled"), F.lit(None).cast("long").alias("open"))
    several = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    opened = firsts.join(several, "anchor", "left_semi").select(F.col("first").alias("id"), F.lit(None).cast("long").alias("settled"), F.col("run").alias("open"))
    wanted = stored(opened.union(settled).groupBy("id").agg(F.collect_set("settled").alias("settled"), F.collect_set("open").alias("open")), "sub-wanted")
    pieces = stored(_pieces(perhaps_among(docs, wanted).join(wanted, "id"), window), "sub-pieces")

    hashed = pieces.filter("hash IS NOT NULL").select("hash", "id", "row", "no")
    # written before they are joined: a hash that many documents have is then a skewed join side, which adaptive execution splits
    earliest = stored(hashed.groupBy("hash").agg(F.min(F.struct("id", "row", "no")).alias("own"), F.max("id").alias("hi")).filter("own.id < hi"), "sub-earliest")
    needed = stored(hashed.join(earliest, "hash").filter("id > own.id").select("id", "row", "no", "own").distinct(), "sub-needed")

    cut = pieces.filter("passage IS NOT NULL").select("id", "row", "no", "start", "passage").dropDuplicates(["id", "row", "no"])
    owners = needed.select("own.*").distinct()
    references = stored(cut.join(owners, ["id", "row", "no"], "left_semi"), "sub-references")
    size = references.agg(F.sum(F.octet_length("passage"))).first()[0] or 0
    shards = F.lit(1 + size // SHARD_BYTES)
    shard = lambda i, r, n: F.pmod(F.xxhash64(i, r, F.floor(n / NEIGHBOURS)), shards)
    routed = needed.select("id", "row", "no", shard(F.col("own.id"), F.col("own.row"), F.col("own.no")).alias("shard")).distinct()
    routed = stored(routed, "sub-routed")
    parts = stored(routed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts")), "sub-parts")

    held = references.withColumn("shard", shard(F.col("id"), F.col("row"), F.col("no"))).join(parts, "shard")
    held = held.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("queried"), "id", "row", "start", "passage")
    asked = routed.join(parts, "shard").select("shard", F.pmod(F.xxhash64("id", "row", "no"), F.col("parts")).alias("part"), F.lit(True).alias("queried"), "id", "row", "no")
    asked = asked.join(cut, ["id", "row", "no"]).select("shard", "part", "queried", "id", "row", "start", "passage")
    return held.union(asked)


def _spans(dealt: DataFrame, window: int) -> DataFrame:
    """id, row, start and end (words) of what the automata mark, shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, references, automaton = None, set(), None
        for b in batches:
            take, starts, ends = [], [], []
            columns = [b.column(k).to_pylist() for k in (0, 2, 3, 5, 6)]
            for i, (s, queried, key, start, passage) in enumerate(zip(*columns, strict=True)):
                if s != shard:
                    shard, references, automaton = s, set(), None
                if not queried:
                    references.add((key, passage))
                    continue
                if automaton is None:
                    automaton, references = SuffixAutomaton([(k, p.split()) for k, p in sorted(references)]), set()
                edge = np.flatnonzero(np.diff(np.concatenate([[0], automaton.marked(passage.split(), key, window).astype(np.int8), [0]])))
                take.append(np.full(len(edge) // 2, i))
                starts.append(start + edge[0::2])
                ends.append(start + edge[1::2])
            if take:
                rows = pa.array(np.concatenate(take))
                yield pa.RecordBatch.from_arrays([b.column(3).take(rows), b.column(4).take(rows), pa.array(np.concatenate(starts)), pa.array(np.concatenate(ends))], ["id", "row", "start", "end"])

    schema = T.StructType([dealt.schema["id"], dealt.schema["row"], T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return dealt.repartition("shard", "part").sortWithinPartitions("shard", "queried").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, spans (array of first and end word of what is removed), kept (binary: the words
    that stay, joined by one space)."""
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).withColumn("row", F.xxhash64("text"))
    spans = _spans(_dealt(plain.filter("id IS NOT NULL AND text IS NOT NULL"), window), window)
    losing = stored(spans.groupBy("id", "row").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "sub-losing")
    perhaps, others = parted_by(plain, losing)  # most documents lose nothing and aren't shuffled
    joined = perhaps.join(losing, ["id", "row"], "left").unionByName(others, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, spans, kept = [], [], [], []
            for data, found in zip(texts(b.column(1)), b.column(2).to_pylist(), strict=True):
                words = data.split()
                n.append(len(words))
                edge = np.zeros(len(words) + 1, np.int64)
                for s in found or ():
                    edge[s["start"]] += 1
                    edge[s["end"]] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                ends = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).tolist()
                removed.append(int(gone.sum()))
                spans.append([{"start": x, "end": y} for x, y in zip(ends[0::2], ends[1::2], strict=True)])
                stay = zip([0, *ends[1::2]], [*ends[0::2], len(words)], strict=True)
                kept.append(b" ".join([w for x, y in stay for w in words[x:y]]))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["id", "n_words", "n_removed", "spans", "kept"])

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([plain.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    return joined.select("id", "text", "spans").mapInArrow(run, schema).withColumnRenamed("id", doc_id)
