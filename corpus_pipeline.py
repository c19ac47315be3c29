"""A corpus from raw documents to token ids: five stages, each written as Parquet before the next one reads it.

All stages but the last return the columns of ``documents``, whatever their names. Rows equal in doc_id are one document: the one with the smallest
hash of its columns stays after the second stage; a null doc_id stays. Null and empty texts fail the quality rules. Texts
of any length go through whole. Ties are settled by ids and hashes, so reruns agree. An empty table gives an empty result
of the same columns. The last stage replaces columns named token_ids or n_tokens, in whatever case.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, mixing, neardup, pii, quality
from graphloom.llm.common import parted_by, stored


def _packed(docs: DataFrame, *needed: str) -> DataFrame:
    """docs with all columns but the needed ones in the struct ``others``, so that no name clashes with an operator's."""
    filler = F.lit(True).alias("_" * (1 + max(map(len, docs.columns))))  # a struct has a field; this name is no column's
    return docs.select(*needed, F.struct(filler, *[F.col(f"`{c}`") for c in docs.columns if c not in needed]).alias("others"))


def _unpacked(packed: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs from what an operator made of _packed()."""
    given = [c for c in packed.columns if c != "others"]
    value = lambda c: changed[c] if c in changed else F.col(f"`{c}`") if c in given else F.col("others").getField(c)
    return packed.select(*[value(c).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules keep."""
    judged = quality.judge(_packed(docs, "text")).filter("qr_kept").select("text", "others")
    return _unpacked(judged, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the one with the smallest doc_id."""
    found = stored(neardup.near_duplicates(docs).filter("doc_id IS NOT NULL").select("doc_id", "kept"), "pipeline-near")
    by_id = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("kept").alias("kept"))
    doubtful = stored(by_id.filter("n > 1 OR NOT kept"), "pipeline-doubtful")
    some, sure = parted_by(docs, doubtful, "doc_id")  # texts that surely stay aren't shuffled
    gone = doubtful.filter("NOT kept").select("doc_id")
    order = F.xxhash64(F.to_json(F.struct(*_names(docs)), {"ignoreNullFields": "false"}))
    stay = some.join(gone, "doc_id", "left_anti").groupBy("doc_id").agg(F.min_by(F.struct(*_names(docs)), order).alias("row"))
    return stay.select("row.*").union(sure)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind, disclosing terms generalised or removed; n_chars follows the text."""
    clean = pii.sanitised(pii.find(_packed(docs, "text")))
    return _unpacked(clean, docs, n_chars=F.char_length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return _unpacked(mixing.copies(mixing.mix(_packed(docs, "doc_id", "text", "source"))), docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """token_ids (little-endian unsigned 32-bit integers) and n_tokens in place of the text."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=False)


STAGES = [("quality rules", quality_rules), ("minhash near-dedup", near_dedup), ("pii", personal_data), ("mixing sources", mix_sources), ("byte-level bpe", byte_bpe)]

#: Expectation-maximisation, byte-pair merges and components have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def _names(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
