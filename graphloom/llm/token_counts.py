"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer.

The histogram has one row for each length that occurs, so it is made by one pre-aggregated shuffle, and written: both
levels of the suffix sums read it, and documents are encoded once. Suffix sums are
taken in two levels: inside a bucket of neighbouring lengths, and over the buckets, of which there are at most
64 * 256 whatever the lengths are.

Defined results: a null or empty text has length 0; texts of any length are encoded whole; no documents give no rows; a
repeated document counts each time; other columns are left behind, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.bpe import codec
from graphloom.llm.common import small_batches, stored


def token_lengths(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """n_tokens of each document, and nothing else."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bpe.count(x or "") for x in b.column(0).to_pylist()], pa.int64())], ["n_tokens"])

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "n_tokens long")


def _bucket(length: Column) -> Column:
    """A monotone key: the length itself below 256, else its exponent and its leading 9 bits."""
    digits = F.length(F.bin(length)) - 9
    return F.when(length < 256, length).otherwise((digits + 1) * 512 + F.call_function("shiftrightunsigned", length, F.greatest(digits, F.lit(0)))).cast("long")


def length_histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """For each length n_tokens that occurs, taken as a context limit:

    n_docs; docs_ge and tokens_ge (documents of that length or more, their tokens); docs_le; total_tokens and
    total_docs (of all documents); truncated_tokens (the tokens left when all documents are cut to n_tokens).
    """
    n = F.col(f"`{column}`").cast("long")
    hist = stored(lengths.groupBy(n.alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs")), "token-lengths")
    hist = hist.withColumn("bucket", _bucket(F.col("n_tokens")))
    tokens = F.col("n_tokens") * F.col("n_docs")
    buckets = hist.groupBy("bucket").agg(F.sum("n_docs").alias("b_docs"), F.sum(tokens).alias("b_tokens"))
    after = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    buckets = buckets.select(
        "bucket",
        F.coalesce(F.sum("b_docs").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("b_tokens").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("b_docs").over(everything).alias("total_docs"),
        F.sum("b_tokens").over(everything).alias("total_tokens"),
    )
    inside = Window.partitionBy("bucket").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    docs_ge, tokens_ge = F.sum("n_docs").over(inside) + F.col("docs_after"), F.sum(tokens).over(inside) + F.col("tokens_after")
    full = hist.join(buckets, "bucket").select("n_tokens", "n_docs", docs_ge.alias("docs_ge"), tokens_ge.alias("tokens_ge"), "total_docs", "total_tokens")
    return full.select(
        "*",
        (F.col("total_docs") - F.col("docs_ge") + F.col("n_docs")).alias("docs_le"),
        (F.col("total_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_tokens"),
    )


def at_limits(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """For any context limits: limit, docs_over (longer documents), truncated_tokens (kept) and dropped_tokens.

    The suffix sums of the shortest length above a limit answer it; one aggregate finds these rows for all limits. An empty
    histogram gives no rows.
    """
    n = F.col("n_tokens")
    each = [F.struct(F.lit(int(x)).cast("long").alias("limit"), F.min(F.when(n > int(x), F.struct("n_tokens", "docs_ge", "tokens_ge"))).alias("next")) for x in limits]
    found = histogram.agg(F.max("total_tokens").alias("total"), F.array(*each).alias("at")).filter("total IS NOT NULL")
    row = found.select("total", F.explode("at").alias("at")).select("total", "at.limit", "at.next")
    over, tokens = (F.coalesce(F.col(f"next.{c}"), F.lit(0)) for c in ("docs_ge", "tokens_ge"))
    dropped = tokens - over * F.col("limit")
    return row.select("limit", over.alias("docs_over"), (F.col("total") - dropped).alias("truncated_tokens"), dropped.alias("dropped_tokens"))


def quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """For each share q: the smallest length that at least q of all documents don't exceed."""
    each = histogram.select("*", F.explode(F.array(*[F.lit(float(q)) for q in shares])).alias("share"))
    return each.filter(F.col("docs_le") >= F.col("share") * F.col("total_docs")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
