"""What an ontology already says of collections: classes, their properties, and the texts by which they are searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.annotate.generate import OWL, RDFS
from graphloom.functions.scalars import local_name
from graphloom.functions.terms import GEO, RDF_TYPE, XSD
from graphloom.operators.closure import reach

RDF = RDF_TYPE.rsplit("type", 1)[0]
#: Kinds of entities, by their type in the ontology, as they stand in a search text.
ENTITIES = {OWL + "Class": "Class", OWL + "ObjectProperty": "Object property", OWL + "DatatypeProperty": "Data property"}


def _of(triples: DataFrame, predicate: str, s: str, o: str) -> DataFrame:
    return triples.filter(F.col("p") == predicate).select(F.col("s").alias(s), F.col("o").alias(o))


def members(triples: DataFrame, heads: DataFrame) -> DataFrame:
    """head, item of the RDF lists that begin at heads (column head), however long: the nodes after a head are found by
    doubling, and all lists are walked at once."""
    rest = _of(triples, RDF + "rest", "x", "y").filter(F.col("y") != RDF + "nil").distinct()
    starts = heads.select("head").distinct()
    seeds = rest.join(starts.withColumnRenamed("head", "x"), "x", "left_semi").select("x", "y")
    nodes = reach(rest, seeds).select(F.col("x").alias("head"), F.col("y").alias("node")).union(starts.select("head", F.col("head").alias("node")))
    return nodes.join(_of(triples, RDF + "first", "node", "item"), "node").select("head", "item").distinct()


def domains(triples: DataFrame) -> DataFrame:
    """property, cls: domains, those in a union (a list of classes) one by one."""
    told = _of(triples, RDFS + "domain", "property", "cls").distinct()
    unions = _of(triples, OWL + "unionOf", "cls", "head")
    spread = told.join(unions, "cls").select("property", "head").join(members(triples, unions), "head").select("property", F.col("item").alias("cls"))
    return told.join(unions.select("cls").distinct(), "cls", "left_anti").select("property", "cls").union(spread).distinct()


def property_type(datatype: Column) -> Column:
    """A range as a schema's type: a number for xsd:float, else the XML schema type's name; a string for anything else."""
    name = F.substring(datatype, F.lit(len(XSD) + 1), F.char_length(datatype))
    return F.when(datatype == XSD + "float", "number").when(F.startswith(datatype, F.lit(XSD)), name).otherwise("string")


def collections(triples: DataFrame, namespace: str) -> DataFrame:
    """cls, title, description, equivalent, property, type, property_equivalent: a row for each property of each class of the
    namespace, and one with null property for a class without any.

    Classes are below geo:Feature or declared as classes; those whose name ends in ``_collection`` are left out. A label,
    comment or equivalent that is told several times is its smallest text.
    """
    local = lambda c: F.startswith(c, F.lit(namespace))
    first = lambda p, s, o: _of(triples, p, s, o).groupBy(s).agg(F.min(o).alias(o))
    below = _of(triples, RDFS + "subClassOf", "cls", "o").filter(F.col("o") == GEO + "Feature").select("cls")
    declared = _of(triples, RDF_TYPE, "cls", "o").filter(F.lower("o") == OWL.lower() + "class").select("cls")
    classes = below.union(declared).distinct().filter(local("cls") & ~F.endswith("cls", F.lit("_collection")))
    for p, name in ((RDFS + "label", "title"), (RDFS + "comment", "description"), (OWL + "equivalentClass", "equivalent")):
        classes = classes.join(first(p, "cls", name), "cls", "left")
    kinds = [RDF + "Property", OWL + "DatatypeProperty", OWL + "ObjectProperty"]
    known = _of(triples, RDF_TYPE, "property", "o").filter(local("property") & F.col("o").isin(kinds)).select("property").distinct()
    own = domains(triples).join(known, "property").join(first(RDFS + "range", "property", "range"), "property", "left")
    own = own.join(first(OWL + "equivalentProperty", "property", "property_equivalent"), "property", "left")
    found = classes.join(own, "cls", "left").withColumn("title", F.coalesce("title", local_name(F.col("cls"))))
    kind = F.when(F.col("property").isNotNull(), property_type(F.coalesce("range", F.lit(""))))
    return found.select("cls", "title", "description", "equivalent", "property", kind.alias("type"), "property_equivalent")


def entity_texts(triples: DataFrame) -> DataFrame:
    """iri, kind, text of an ontology's classes and properties: what their vectors are made of."""
    first = lambda p, o: _of(triples, p, "iri", o).groupBy("iri").agg(F.min(o).alias(o))
    names = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])
    kinds = _of(triples, RDF_TYPE, "iri", "o").filter(F.col("o").isin(list(ENTITIES))).select("iri", names[F.col("o")].alias("kind")).distinct()
    told = kinds.join(first(RDFS + "label", "label"), "iri", "left").join(first(RDFS + "comment", "comment"), "iri", "left")
    part = lambda name, c: F.concat(F.lit(f" {name}: "), F.coalesce(c, F.lit("")), F.lit("."))
    text = F.trim(F.concat(F.col("kind"), F.lit(": "), local_name(F.col("iri")), F.lit("."), part("Label", "label"), part("Description", "comment")))
    return told.select("iri", "kind", text.alias("text"))


def report(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """cls, report: of each class of collections() one JSON document with its decision and its properties' ones, in a fixed
    order, so that reruns give the same bytes. decisions: local, accepted, source."""
    told = decisions.groupBy("local").agg(F.min(F.struct("source", "accepted")).alias("decision"))
    with_own = found.join(told.withColumnRenamed("local", "property").withColumnRenamed("decision", "property_decision"), "property", "left")
    one = F.struct("property", "type", "property_equivalent", F.col("property_decision").alias("decision"))
    listed = F.array_sort(F.collect_set(F.when(F.col("property").isNotNull(), one)), lambda a, b: F.when(a["property"] < b["property"], -1).when(a["property"] > b["property"], 1).otherwise(0))
    grouped = with_own.groupBy("cls", "title", "description", "equivalent").agg(listed.alias("properties"))
    whole = grouped.join(told.withColumnRenamed("local", "cls"), "cls", "left")
    aligned = F.size(F.filter("properties", lambda p: p["property_equivalent"].isNotNull() | p["decision"].isNotNull()))
    statistics = F.struct(F.size("properties").alias("properties"), aligned.alias("aligned"))
    text = F.to_json(F.struct("cls", "title", "description", "equivalent", "decision", statistics.alias("statistics"), "properties"), {"ignoreNullFields": "false"})
    return whole.select("cls", text.alias("report"))


#: How many classes, entities and properties a sample has, and how many properties a proposal is shown.
SAMPLE = {"class": 100, "entity": 120, "property": 100}


def mentioned(triples: DataFrame) -> DataFrame:
    """kind (class, property, entity), iri: what an ontology declares or uses as such; entities are classes and properties."""
    kind = lambda *names: F.col("o").isin(list(names))
    typed, below, domain = F.col("p") == RDF_TYPE, F.col("p") == RDFS + "subClassOf", F.col("p") == RDFS + "domain"
    is_class = typed & kind(OWL + "Class", OWL + "class", RDFS + "Class")
    is_property = typed & kind(RDF + "Property", OWL + "ObjectProperty", OWL + "DatatypeProperty")
    some = lambda where, c, k: F.when(where, F.struct(F.lit(k).alias("kind"), F.col(c).alias("iri")))
    told = [some(is_class | below, "s", "class"), some(below | domain, "o", "class"), some(is_property | domain, "s", "property")]
    each = triples.select(F.explode(F.array_compact(F.array(*told))).alias("m")).select("m.*").filter(~F.startswith("iri", F.lit("_:"))).distinct()
    return each.union(each.select(F.lit("entity").alias("kind"), "iri")).distinct()


def samples(triples: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """kind, iri, label, comment of the first classes, properties and entities by IRI, ``most`` of each kind."""
    found = mentioned(triples)
    parts = [found.filter(F.col("kind") == k).orderBy("iri").limit(n) for k, n in (SAMPLE | (most or {})).items()]
    chosen = parts[0].union(parts[1]).union(parts[2])
    for p, name in ((RDFS + "label", "label"), (RDFS + "comment", "comment")):
        told = _of(triples, p, "iri", name).groupBy("iri").agg(F.min(name).alias(name))
        chosen = chosen.join(told, "iri", "left")
    return chosen.select("kind", "iri", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("comment", F.lit("")).alias("comment"))
