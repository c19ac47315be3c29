"""Alignment of local classes and properties with reference vocabularies, and what follows from it for mappings.

A decision is a row: local IRI, accepted IRI, source (baseline, local, external, proposal). Lookups in remote endpoints and
language models are decisions made elsewhere and joined here; nothing calls them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.terms import RDF_TYPE, Const
from graphloom.sources.mapping import TriplesMap

OWL = "http://www.w3.org/2002/07/owl#"
EQUIVALENT = {"class": OWL + "equivalentClass", "property": OWL + "equivalentProperty"}
#: The order in which sources of decisions are asked.
CASCADE = ("baseline", "local", "external", "proposal")
RESTRICTIONS = ("someValuesFrom", "allValuesFrom", "hasValue", "minCardinality", "maxCardinality", "cardinality")


def decide(decisions: DataFrame, order: Sequence[str] = CASCADE) -> DataFrame:
    """One decision for each local IRI: of the first source in order that has one, the most confident (ties: least IRI)."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    first = Window.partitionBy("local").orderBy("rank", F.col("confidence").desc(), "accepted")
    return decisions.withColumn("rank", rank).filter("rank > 0").withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "rank")


def candidates(nearest: DataFrame) -> DataFrame:
    """Ranked candidates as decisions of the source ``local``."""
    return nearest.select(F.col("term").alias("local"), F.col("entity").alias("accepted"), F.lit("local").alias("source"), F.col("score").alias("confidence"))


def equivalences(triples: DataFrame) -> DataFrame:
    """local, accepted, kind of the equivalences that an ontology (s, p, o) states."""
    kind = F.when(F.col("p") == EQUIVALENT["class"], "class").when(F.col("p") == EQUIVALENT["property"], "property")
    return triples.select(F.col("s").alias("local"), F.col("o").alias("accepted"), kind.alias("kind")).filter("kind IS NOT NULL")


def without_equivalences(triples: DataFrame) -> DataFrame:
    return triples.filter(~F.col("p").isin(*EQUIVALENT.values()))


def annotated(triples: DataFrame, decisions: DataFrame, kind: str) -> DataFrame:
    """The ontology with the decisions as equivalences; those that it had for the same IRIs are replaced."""
    new = decisions.select(F.col("local").alias("s"), F.lit(EQUIVALENT[kind]).alias("p"), F.col("accepted").alias("o"))
    old = triples.filter(F.col("p") == EQUIVALENT[kind]).join(new.select("s"), "s", "left_anti").select("s", "p", "o")
    return triples.filter(F.col("p") != EQUIVALENT[kind]).select("s", "p", "o").union(old).union(new).distinct()


def known_resources(triples: DataFrame) -> DataFrame:
    """All IRIs that an ontology mentions."""
    looks = F.col("iri").rlike(r"^[a-z][a-z0-9+.-]*:\S*$")
    return triples.select(F.explode(F.array("s", "p", "o")).alias("iri")).filter(looks).distinct()


def restrictions(proposed: DataFrame, known: DataFrame) -> DataFrame:
    """The four triples of each sound restriction (class, property, quantifier, value); a cardinality is a whole number,
    other values and all IRIs must be known."""
    whole = F.col("quantifier").endswith("ardinality")
    fine = F.col("quantifier").isin(*RESTRICTIONS) & F.when(whole, F.col("value").rlike("^[0-9]+$")).otherwise(True)
    iris = known.select("iri").distinct()
    held = proposed.filter(fine)
    for c in ("class", "property"):
        held = held.join(iris.withColumnRenamed("iri", c), c, "left_semi")
    given = held.filter(~whole).join(iris.withColumnRenamed("iri", "value"), "value", "left_semi")
    held = held.filter(whole).unionByName(given)
    node = F.concat(F.lit("_:r"), F.substring(F.sha2(F.concat_ws("\t", "class", "property", "quantifier", "value"), 256), 1, 16))
    rows = [("class", F.lit("http://www.w3.org/2000/01/rdf-schema#subClassOf"), node), (node, F.lit(RDF_TYPE), F.lit(OWL + "Restriction")), (node, F.lit(OWL + "onProperty"), F.col("property")), (node, F.concat(F.lit(OWL), F.col("quantifier")), F.col("value"))]
    each = F.explode(F.array(*[F.struct((F.col(s) if isinstance(s, str) else s).alias("s"), p.alias("p"), o.alias("o")) for s, p, o in rows]))
    return held.select(each.alias("t")).select("t.*").distinct()


def axioms(proposed: DataFrame, known: DataFrame) -> DataFrame:
    """Proposed triples (s, p, o) of known IRIs; domains and ranges are not up for proposal."""
    held = proposed.filter(~F.col("p").rlike("#(domain|range)$"))
    for c in "spo":
        held = held.join(known.select(F.col("iri").alias(c)).distinct(), c, "left_semi")
    return held.select("s", "p", "o").distinct()


def rewritten(maps: Sequence[TriplesMap], accepted: dict[str, str], reset: dict[str, str] | None = None) -> list[TriplesMap]:
    """Mappings with classes and predicates replaced by what they were aligned with. reset: local IRI -> what it was aligned
    with before; that is undone first, so that mappings may be aligned again."""
    back = {old: local for local, old in (reset or {}).items()}
    new = lambda iri: accepted.get(back.get(iri, iri), back.get(iri, iri))
    name = lambda p: str(getattr(p, "value", p))
    objects = lambda m: tuple((new(name(p)), Const(new(str(o.value))) if isinstance(o, Const) and o.kind == "iri" else o) for p, o in m.objects)
    return [replace(m, classes=tuple(map(new, m.classes)), objects=objects(m), push=tuple((new(name(p)), k) for p, k in m.push)) for m in maps]


def coverage(triples: DataFrame, local: str) -> DataFrame:
    """kind, total, aligned, coverage_pct: how many of a namespace's classes and properties have an equivalence."""
    own = triples.filter((F.col("p") == RDF_TYPE) & F.startswith("s", F.lit(local)))
    kinds = own.select("s", F.when(F.endswith("o", F.lit("#Class")), "class").when(F.endswith("o", F.lit("Property")), "property").alias("kind")).filter("kind IS NOT NULL").distinct()
    with_one = equivalences(triples).select(F.col("local").alias("s"), "kind", F.lit(1).alias("hit")).distinct()
    joined = kinds.join(with_one, ["s", "kind"], "left")
    share = F.round(100 * F.count("hit") / F.count(F.lit(1)), 4)
    return joined.groupBy("kind").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("aligned"), share.alias("coverage_pct"))


def by_source(decisions: DataFrame) -> DataFrame:
    """Decisions of each kind by source, one column each."""
    return decisions.groupBy("kind").pivot("source", list(CASCADE)).count().na.fill(0)


def occurrences(rows: DataFrame) -> DataFrame:
    """Of each property (property, datatype, collection, source): its datatypes, collections and sources, sorted."""
    sets = [F.array_join(F.array_sort(F.collect_set(c)), ",").alias(f"{c}s") for c in ("datatype", "collection", "source")]
    return rows.groupBy("property").agg(*sets, F.count(F.lit(1)).alias("occurrences"))
