"""Analytics of benchmark runs: summaries, comparisons of variants, validity by the most frequent result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def statistics(metric: str, where: Column | None = None) -> list[Column]:
    """Mean, sample deviation (0 for a single value), least and largest of a metric."""
    x = F.col(f"`{metric}`").cast("double")
    x = F.when(where, x) if where is not None else x
    return [F.avg(x).alias(f"{metric}_mean"), F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x)).alias(f"{metric}_stdev"), F.min(x).alias(f"{metric}_min"), F.max(x).alias(f"{metric}_max")]


def summary(runs: DataFrame, metrics: Sequence[str], order: str = "execution_order") -> DataFrame:
    """By query_id and variant: runs in all, successful and failed, the metrics' statistics over successful runs, whether
    these agree in rows and hash, and what the first of them gave."""
    good = F.col("status") == "success"
    first = lambda c: F.min_by(F.when(good, F.struct(F.col(c).alias("v"))), F.when(good, F.col(order)))["v"].alias(c)
    lows, highs = (f(F.when(good, F.struct("result_rows", "result_hash"))) for f in (F.min, F.max))
    return runs.groupBy("query_id", "variant").agg(
        F.count(F.lit(1)).alias("runs_total"),
        F.count_if(good).alias("runs_successful"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("runs_failed"),
        *[c for m in metrics for c in statistics(m, good)],
        lows.eqNullSafe(highs).alias("result_consistent"),
        first("result_rows"),
        first("result_hash"),
    )


def compare(found: DataFrame, reference: str, candidate: str, metrics: Sequence[str], time: str = "total_time_seconds") -> DataFrame:
    """For each query that both variants ran: reductions in per cent, the speed-up, and whether the results agree."""
    columns = ["query_id", "runs_successful", "result_rows", "result_hash", *[f"{m}_mean" for m in metrics]]

    def side(variant: str, mark: str) -> DataFrame:
        return found.filter(F.col("variant") == variant).select("query_id", *[F.col(c).alias(f"{mark}_{c}") for c in columns[1:]])

    both = side(reference, "reference").join(side(candidate, "candidate"), "query_id")
    reduction = lambda m: F.when(F.col(f"reference_{m}_mean") == 0, F.lit(0.0)).otherwise((F.col(f"reference_{m}_mean") - F.col(f"candidate_{m}_mean")) / F.col(f"reference_{m}_mean") * 100)
    return both.select(
        "query_id",
        F.lit(reference).alias("reference_variant"),
        F.lit(candidate).alias("candidate_variant"),
        "reference_runs_successful",
        "candidate_runs_successful",
        F.col("reference_result_rows").eqNullSafe(F.col("candidate_result_rows")).alias("result_rows_match"),
        F.col("reference_result_hash").eqNullSafe(F.col("candidate_result_hash")).alias("result_hash_match"),
        *[F.when(F.col(f"reference_{m}_mean").isNotNull() & F.col(f"candidate_{m}_mean").isNotNull(), reduction(m)).alias(f"{m}_reduction_pct") for m in metrics],
        F.try_divide(f"reference_{time}_mean", f"candidate_{time}_mean").alias("speedup"),
    )


def validity(runs: DataFrame) -> DataFrame:
    """runs with ``valid``: successful, and with the query's most frequent hash among successes (ties: the least)."""
    good = runs.filter("status = 'success'").groupBy("query_id", "result_hash").agg(F.count(F.lit(1)).alias("n"))
    best = good.groupBy("query_id").agg(F.min_by("result_hash", F.struct(-F.col("n"), "result_hash")).alias("usual_hash"))
    valid = (F.col("status") == "success") & (F.col("result_hash") == F.col("usual_hash"))
    return runs.join(best, "query_id", "left").withColumn("valid", F.coalesce(valid, F.lit(False)))


def success_rate(runs: DataFrame) -> DataFrame:
    return validity(runs).groupBy("query_id", "variant").agg(F.avg(F.col("valid").cast("double")).alias("success_rate"))


def call_totals(calls: DataFrame, by: Sequence[str]) -> DataFrame:
    """API calls, how many went well, bytes and seconds."""
    ok = F.col("status_code").between(200, 299)
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.count_if(ok).alias("calls_ok"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("calls_failed"), F.sum("bytes").alias("bytes"), F.sum("seconds").alias("seconds"))


def pending(planned: DataFrame, completed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned runs that a resumed evaluation still has to make."""
    return planned.join(completed.select(*keys).distinct(), list(keys), "left_anti")


def numbered(runs: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "call_index") -> DataFrame:
    return runs.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def duplicate_triples(attempts: DataFrame) -> DataFrame:
    """Attempted additions to a set of triples, distinct ones, and the difference."""
    per = attempts.groupBy("s", "p", "o").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("attempts"), F.count(F.lit(1)).alias("distinct_triples"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))


def time_breakdown(runs: DataFrame, variant: str = "final") -> DataFrame:
    """By query: the mean seconds that valid runs of a variant spent on sources and in the engine."""
    mine = validity(runs).filter(F.col("valid") & (F.col("variant") == variant))
    return mine.groupBy("query_id").agg(F.avg("api_time_seconds").alias("api_seconds"), F.avg("engine_time_seconds").alias("engine_seconds"))


def review_outcomes(reviews: DataFrame, by: Sequence[str]) -> DataFrame:
    """Reviewed entities that had candidates, and those for which one was accepted (candidates: array, selected: IRI or null)."""
    return reviews.groupBy(*by).agg(F.count_if(F.size("candidates") > 0).alias("with_candidates"), F.count_if(F.col("selected").isNotNull()).alias("accepted"))


def ordered(planned: DataFrame, completed: DataFrame, keys: Sequence[str], seed: int | None = None) -> DataFrame:
    """Planned runs that are still to be made, numbered on from what has been completed; with a seed in an order of its own.

    A plan has as many rows as an evaluation has runs, so one task numbers them.
    """
    last = completed.agg(F.coalesce(F.max("execution_order"), F.lit(0)).alias("last"))
    order = [F.sha2(F.concat_ws(":", F.lit(str(seed)), *keys), 256)] if seed is not None else list(keys)
    left = pending(planned, completed, keys).crossJoin(F.broadcast(last))  # one row
    return left.withColumn("execution_order", F.col("last") + F.row_number().over(Window.orderBy(*order))).drop("last")


def append(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Adds rows to a log of JSON lines, CSV with a header, or Parquet."""
    rows.write.mode("append").options(header="true").format(kind).save(path)


class RunLog:
    """A log of runs in versions. Rows are appended to the current version; resume() writes a new one with what is retained,
    and only then says so in the manifest: a reader sees the one or the other, and a crash between leaves the old one. Old
    versions stay as the archive."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def version(self) -> int:
        """The current version; 0 before anything has been resumed."""
        try:
            found = self.spark.read.schema("version int").json(f"{self.path}/manifest")
            return found.agg(F.max("version")).first()[0] or 0
        except AnalysisException:
            return 0

    def at(self, version: int) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(f"{self.path}/version={version}")
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self.at(self.version())

    def append(self, rows: DataFrame) -> None:
        rows.select(*self.at(0).columns).write.mode("append").parquet(f"{self.path}/version={self.version()}")

    def resume(self, keys: Sequence[str], retained: Column | None = None, latest: str = "execution_order") -> DataFrame:
        """Keeps one row for each key (the one with the largest ``latest``), of those that retained holds for (by default the
        successful runs), as a new version, and returns it."""
        now = self.version()
        kept = self.read().filter(retained if retained is not None else F.col("status") == "success")
        columns = F.struct(*[F.col(f"`{c}`") for c in kept.columns])
        one = kept.groupBy(*keys).agg(F.max_by(columns, F.struct(F.col(latest), F.xxhash64(columns))).alias("row")).select("row.*")
        one.write.mode("overwrite").parquet(f"{self.path}/version={now + 1}")
        self.spark.createDataFrame([(now + 1,)], "version int").coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return self.read()
