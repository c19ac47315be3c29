"""The thin queries opN_<name> of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, fim, html, mixing, neardup, pii, quality, ranked, secrets, sql, substrings, token_counts, topk, toxicity
from graphloom.llm.spans import written

#: The rank file and pre-token pattern that op1 and op7 use.
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return token_counts.length_histogram(token_counts.token_lengths(docs, RANKS, PATTERN))


def op2_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    found = topk.top_k(table.filter(F.col("vec_id") % 50 == 0), table, k=5, scale=256.0)
    return found.withColumnRenamed("id", "vec_id")


def op3_minhash_neardup(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), words=2, hundredths=80)


def op4_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source"))
    taken = F.col("mix_size") * F.col("mix_copies")
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken.alias("taken"))


def op5_html_text(spark: SparkSession, sf: str) -> DataFrame:
    found = html.extract(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.judge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), keep_text=False)
    counts = {"n_words": "qr_words", "word_chars": "qr_word_chars", "n_symbols": "qr_symbols", "n_dup_lines": "qr_dup_lines", "n_repeat_words": "qr_repeat_words", "base_failed": "qr_base_failed", "kept": "qr_kept", "posterior": "qr_posterior"}
    return judged.select("doc_id", *[F.col(c).alias(n) for n, c in counts.items()])


def op7_bpe_codec(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _counts(spans: str, kinds: tuple[str, ...]) -> list:
    return [F.size(F.filter(F.transform(spans, lambda s: s["kind"]), F.lit(k).eqNullSafe)).cast("long").alias(f"n_{k}") for k in kinds]


def op8_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", *_counts("pii_base", pii.KINDS[:4]), F.sha2(written(F.col("pii_base")), 256).alias("base_sha256"), written(F.col("pii_spans")).alias("spans"))


def op9_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.find(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", *_counts("secret_base", secrets.KINDS[:3]), F.sha2(written(F.col("secret_base")), 256).alias("base_sha256"), written(F.col("secret_spans")).alias("spans"))


def op10_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = substrings.remove_repeats(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))


def op12_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    made = fim.transform(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    digests = {"output_sha256": F.col("fim_output"), "restored_sha256": fim.restored(F.col("fim_output"), F.col("fim_form"))}
    plain = {"n": "fim_units", "form": "fim_form", "prefix_chars": "fim_prefix_chars", "middle_chars": "fim_middle_chars"}
    return made.select("doc_id", *[F.col(c).alias(n) for n, c in plain.items()], *[F.sha2(x, 256).alias(n) for n, x in digests.items()])


def op13_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranked.search(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"), k=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (op1_token_counts, op2_exact_topk, op3_minhash_neardup, op4_mix_sources, op5_html_text, op6_quality_rules, op7_bpe_codec, op8_pii, op9_secrets, op10_substring_dedup, op11_toxicity, op12_fill_in_middle, op13_ranked_search)
    return {f.__name__: f for f in operators}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": sql.OP2, "op10_substring_dedup": sql.OP10, "op12_fill_in_middle": sql.OP12, "op13_ranked_search": sql.OP13}
