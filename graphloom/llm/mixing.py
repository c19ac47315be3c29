"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Each source has a target size. A document is expected in the mix m times: in proportion to its weight, ``most`` times at
most, and so that the expected words of a source are its target. The whole part of m is allotted as certain copies; the
fraction is the document's inclusion probability p for one more. Documents are ranked by ``odds(u) / odds(p)`` with u a
hash of id and text, and the lowest ranks are taken until the words that the copies leave open are reached.

A document's weight is a column of the caller's or, by default, follows its length: 0.5 for the shortest to 1.5 for the
longest, 1 at HALF words, as long documents have what short ones lack, context. Weights are rounded to STEPS steps an
octave: sums by source and step decide exactly which documents reach ``most`` and what the others' m is.

No source is sorted or summed in one task: words are summed in 1024 bins of the rank, then in 1024 bins of the one that
holds the cut, and only the rows of that last bin (about a millionth of the source) are ordered, equal ones as one. What
comes out is one threshold a source, so the documents themselves are never shuffled where the sources' table is small.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, the last; with no words at
all nothing is taken; a weight that is null, not positive or not finite counts as 1; a null id is told apart by its
text; rows equal in id and text are one tie, taken or left together; very long texts are only counted and hashed; no
documents give no rows; other columns pass through whatever their names, those named mix_* are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
BINS = 1024
#: Steps of weights in an octave, and the number of words at which a document's own weight is 1.
STEPS, HALF = 16, 200


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(table: DataFrame, key: str) -> DataFrame:
    """Adds ``rank`` from 0 by key, whatever the number of rows: ranges are sorted apart, then get their offsets."""
    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = stored(table.repartitionByRange(n, key).withColumn("part", F.spark_partition_id()), "mix-ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy(key)
    return parts.join(offsets, "part").withColumn("rank", F.col("offset") + F.row_number().over(inside) - 1).drop("part", "offset")


def targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3) -> DataFrame:
    """From mix_key and mix_size: mix_key, source_size, target of each source.

    Sources in code-point order weigh as ``weights`` says, repeating. All words are shared by weight; a target
    above ``most`` times its source stops there, and the excess is shared again until none is above.
    """
    totals = sizes.groupBy("mix_key").agg(F.sum("mix_size").alias("source_size"))
    named = _ranked(totals, "mix_key")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = stored(named.select("mix_key", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("top")), "mix-sources")
    everything = table.agg(F.sum("source_size"), F.sum("weight")).first()
    level = everything[0] / everything[1] if everything[1] else 0.0
    while level:  # one number comes to the driver in each round
        above = F.col("top") < F.lit(level) * F.col("weight")
        row = table.agg(F.sum(F.when(above, F.col("top"))), F.sum(F.when(~above, F.col("weight")))).first()
        higher = (everything[0] - (row[0] or 0.0)) / row[1] if row[1] else level
        if higher <= level:
            break
        level = higher
    return table.select("mix_key", "source_size", F.least("top", F.lit(float(level)) * F.col("weight")).alias("target"))


def by_length(size: Column) -> Column:
    """A document's weight by its number of words."""
    return 0.5 + size / (size + HALF)


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """The random number u of a document, between 0 and 1: the same in every run."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 11)
    return (bits + F.lit(0.5)) / F.lit(float(1 << 53))


def _chances(sizes: DataFrame, wanted: DataFrame, most: float) -> DataFrame:
    """mix_whole and mix_p of each source and weight step, with the source's size, target and open words.

    If all steps above one stop at ``most``, the others' m is weight * (target - most * words above) / (weighted words of
    the others); the highest step for which that doesn't exceed ``most`` is the right one.
    """
    words = sizes.groupBy("mix_key", "mix_step").agg(F.sum("mix_size").alias("words")).join(wanted, "mix_key")
    by_step = Window.partitionBy("mix_key").orderBy(F.col("mix_step").desc())
    above, rest = by_step.rowsBetween(Window.unboundedPreceding, -1), by_step.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight, whole_source = F.pow(F.lit(2.0), F.col("mix_step") / STEPS), Window.partitionBy("mix_key")
    words = words.withColumn("weight", weight)
    scale = F.try_divide(F.col("target") - most * F.coalesce(F.sum("words").over(above), F.lit(0)), F.sum(F.col("words") * F.col("weight")).over(rest))
    words = words.withColumn("scale", scale)
    fits = F.when(F.col("scale") * F.col("weight") <= most * (1 + 1e-12), F.struct("mix_step", "scale"))
    words = words.withColumn("scale", F.max(fits).over(whole_source)["scale"])
    m = F.when(F.col("target") > 0, F.least(F.lit(float(most)), F.coalesce(F.col("scale") * F.col("weight"), F.lit(float(most))))).otherwise(0.0)
    words = words.withColumn("m", m).withColumn("mix_whole", F.floor(F.col("m") + F.lit(1e-9)))
    p = F.col("m") - F.col("mix_whole")
    words = words.withColumn("mix_p", F.when(p > 1e-9, p).otherwise(0.0))
    opened = F.sum(F.col("words") * F.col("mix_p")).over(whole_source).alias("mix_open")
    return words.select("mix_key", "mix_step", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), "mix_whole", "mix_p", opened)


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: Sequence[float] = (1, 2, 3), most: float = 3, seed: int = 17, weight: str | None = None) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies (how often the mix takes the document).

    weights: of the sources, repeating. weight: the column of the documents' own weights.
    """
    key = F.coalesce(F.concat(F.lit("a"), F.col(f"`{source}`").cast("string")), F.lit("b"))  # null comes last
    names = [F.col(f"`{c}`") for c in docs.columns if not c.lower().startswith("mix_")]
    marks = {"mix_key": key, "mix_size": n_words(text), "mix_u": draw(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), seed), "mix_tie": F.xxhash64(F.col(f"`{text}`"), F.col(f"`{doc_id}`"), F.lit(seed + 1))}
    plain = docs.select(*names, *[c.alias(n) for n, c in marks.items()], *([F.col(f"`{weight}`").cast("double").alias("mix_own")] if weight else []))
    own = F.col("mix_own") if weight else by_length(F.col("mix_size"))
    sound = (own > 0) & (own < F.lit(float("inf")))
    plain = plain.withColumn("mix_step", F.coalesce(F.round(F.when(sound, F.log2(own)) * STEPS).cast("int"), F.lit(0)))
    sizes = stored(plain.select("mix_key", "mix_size", "mix_step", "mix_u", "mix_tie"), "mix-sizes")
    chances = stored(_chances(sizes, targets(sizes, weights, most), most), "mix-chances")

    def ordered(frame: DataFrame) -> DataFrame:
        """Adds the rank variable and its two bins. q / (1 + q) lies between 0 and 1."""
        odds = lambda x: F.col(x) / (1 - F.col(x))
        q = F.when(F.col("mix_p") > 0, odds("mix_u") / odds("mix_p"))
        z = F.col("mix_q") / (1 + F.col("mix_q")) * BINS
        frame = frame.withColumn("mix_q", q).withColumn("mix_z", z)
        first = F.least(F.floor("mix_z"), F.lit(BINS - 1))
        return frame.withColumn("mix_a", first).withColumn("mix_b", F.floor((F.col("mix_z") - first) * BINS)).drop("mix_z")

    def cut(bins: DataFrame, bin_: str) -> DataFrame:
        """The first bin of each source after which more words than mix_open have been met, and the words before it."""
        before = Window.partitionBy("mix_key").orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
        met = bins.withColumn("base", F.col("base") + F.coalesce(F.sum("words").over(before), F.lit(0)))
        return met.filter(F.col("base") + F.col("words") > F.col("mix_open")).groupBy("mix_key").agg(F.min_by(F.struct(F.col(bin_).alias("bin"), "base"), bin_).alias("cut"))

    rows = ordered(sizes.join(chances.filter("mix_p > 0"), ["mix_key", "mix_step"]))
    one = cut(rows.groupBy("mix_key", "mix_a").agg(F.sum("mix_size").alias("words"), F.first("mix_open").alias("mix_open"), F.lit(0).alias("base")), "mix_a")
    one = stored(one.select("mix_key", F.col("cut.bin").alias("mix_cut_a"), F.col("cut.base").alias("base")), "mix-cut")
    within = rows.join(one, "mix_key").filter(F.col("mix_a") == F.col("mix_cut_a"))
    two = cut(within.groupBy("mix_key", "mix_b").agg(F.sum("mix_size").alias("words"), F.first("mix_open").alias("mix_open"), F.first("base").alias("base")), "mix_b")
    two = stored(two.select("mix_key", F.col("cut.bin").alias("mix_cut_b"), F.col("cut.base").alias("base2")), "mix-cut")
    last = within.join(two, "mix_key").filter(F.col("mix_b") == F.col("mix_cut_b"))
    last = last.groupBy("mix_key", "mix_q", "mix_tie").agg(F.sum("mix_size").alias("words"), F.first("mix_open").alias("mix_open"), F.first("base2").alias("base2"))
    before = Window.partitionBy("mix_key").orderBy("mix_q", "mix_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("upto", F.col("base2") + F.sum("words").over(before))
    last = last.filter(F.col("upto") - F.col("words") / 2 <= F.col("mix_open")).groupBy("mix_key").agg(F.max(F.struct("mix_q", "mix_tie")).alias("mix_end"))
    plan = chances.join(one.select("mix_key", "mix_cut_a"), "mix_key", "left").join(two.select("mix_key", "mix_cut_b"), "mix_key", "left").join(last, "mix_key", "left")
    plan = stored(plan, "mix-plan")

    every = ordered(plain.join(plan, ["mix_key", "mix_step"], "left"))
    at = F.struct("mix_a", "mix_b", "mix_q", "mix_tie")
    end = F.struct(F.col("mix_cut_a"), F.col("mix_cut_b"), F.coalesce(F.col("mix_end.mix_q"), F.lit(-1.0)), F.coalesce(F.col("mix_end.mix_tie"), F.lit(0)).cast("long"))
    # where no bin passes the open words, all of the source's ranks are below them
    more = F.when((F.col("mix_p") > 0) & (F.col("mix_cut_b").isNull() & (F.col("mix_open") > 0) | (at <= end)), 1).otherwise(0)
    return every.select(*names, "mix_size", "mix_source_size", "mix_target", (F.col("mix_whole") + more).cast("long").alias("mix_copies"))


def copies(mixed: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it, with the columns it had."""
    names = [c for c in mixed.columns if not c.lower().startswith("mix_")]
    many = mixed.filter("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return many.select(*[f"`{c}`" for c in names])
