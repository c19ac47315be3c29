"""Ontologies and mappings from schemas: what a table or a features service has, as triples and as a TriplesMap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.geometry import bbox_parse, bbox_wkt
from graphloom.functions.terms import GEO, RDF_TYPE, XSD, Ref, Template
from graphloom.sources.mapping import Source, TriplesMap

RDFS, OWL = "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
#: Types of JSON schema and of Spark as datatypes; others are ``xsd:<type>`` as they stand.
DATATYPES = {"number": XSD + "float", "double": XSD + "float", "float": XSD + "float", "bigint": XSD + "long", "long": XSD + "long", "int": XSD + "integer", "geometry": GEO + "geoJSONLiteral", "timestamp": XSD + "dateTime"}


def datatype_of(kind: Column) -> Column:
    out = F.concat(F.lit(XSD), kind)
    for name, iri in DATATYPES.items():
        out = F.when(kind == name, F.lit(iri)).otherwise(out)
    return out


def schema_rows(df: DataFrame, collection: str) -> DataFrame:
    """collection, property, type of each column; nested ones by their path."""

    def fields(schema: T.StructType, before: str = "") -> list[tuple[str, str, str]]:
        out = []
        for f in schema.fields:
            if isinstance(f.dataType, T.StructType):
                out += fields(f.dataType, f"{before}{f.name}.")
            else:
                out.append((collection, before + f.name, f.dataType.simpleString()))
        return out

    return df.sparkSession.createDataFrame(fields(df.schema), "collection string, property string, type string")


def queryables(collections: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """From id and properties (name -> struct with ``type``), as a features service describes itself: collection, property, type."""
    chosen = collections.filter(F.col("id").isin(allowed)) if allowed is not None else collections
    return chosen.select(F.col("id").alias("collection"), F.explode("properties").alias("property", "about")).select("collection", "property", F.col("about")["type"].alias("type"))


def ontology(rows: DataFrame, namespace: str) -> DataFrame:
    """Triples (s, p, o as texts) of classes below geo:Feature and of properties with label, range and domains.

    rows: collection, property, type, and perhaps title and description of the collection, and bbox (xmin,ymin,xmax,ymax)
    with crs: then the class has a comment, and its collection of features a bounding box.
    """
    ns = F.lit(namespace)
    more = {c: F.col(c) if c in rows.columns else F.lit(None).cast("string") for c in ("title", "description", "bbox", "crs")}
    rows = rows.select("collection", "property", "type", *[x.alias(c) for c, x in more.items()])
    cls, prop = F.concat(ns, F.col("collection")), F.concat(ns, F.element_at(F.split("property", r"\."), -1))
    whole = F.concat(cls, F.lit("_collection"))
    classes = rows.select(cls.alias("s"), F.coalesce("title", "collection").alias("name"), "description", "bbox", "crs", whole.alias("whole")).distinct()
    told = lambda df, p, o, s="s": df.filter(o.isNotNull()).select(F.col(s).alias("s"), F.lit(p).alias("p"), o.alias("o"))
    properties = rows.select(prop.alias("s"), F.element_at(F.split("property", r"\."), -1).alias("name"), datatype_of(F.col("type")).alias("range"), cls.alias("domain"))
    node = classes.withColumn("node", F.concat(F.lit("_:box_"), F.substring(F.sha2("whole", 256), 1, 16)))
    bounded = node.filter("bbox IS NOT NULL AND crs IS NOT NULL")
    wkt = F.concat(F.lit("<"), F.col("crs"), F.lit("> "), bbox_wkt(bbox_parse(F.col("bbox"))))
    parts = [
        told(classes, RDF_TYPE, F.lit(OWL + "Class")),
        told(classes, RDFS + "subClassOf", F.lit(GEO + "Feature")),
        told(classes, RDFS + "label", F.col("name")),
        told(classes, RDFS + "comment", F.col("description")),
        told(bounded, RDF_TYPE, F.lit(GEO + "FeatureCollection"), "whole"),
        told(bounded, GEO + "hasBoundingBox", F.col("node"), "whole"),
        told(bounded, GEO + "asWKT", wkt, "node"),
        told(properties, RDF_TYPE, F.lit(OWL + "DatatypeProperty")),
        told(properties, RDFS + "label", F.col("name")),
        told(properties, RDFS + "range", F.col("range")),
        told(properties, RDFS + "domain", F.col("domain")),
    ]
    return reduce(DataFrame.union, parts).distinct()


def mapping(df: DataFrame, source: Source, namespace: str, key: str, unique: bool = True) -> TriplesMap:
    """The map of a source's columns: subject by the key, one property for each column, arrays as many values."""
    objects = []
    for _, path, kind in [tuple(r) for r in _plain(df, source.name)]:
        name = path.replace("[*]", "").split(".")[-1]
        datatype = DATATYPES.get(kind, XSD + kind)
        objects.append((namespace + name, Ref(path, datatype)))
    return TriplesMap(source.name, source, Template(f"{namespace}{source.name}/{{{key}}}"), tuple(objects), (namespace + source.name,), unique, tuple((p, r.path.split(".")[-1]) for p, r in objects))


def _plain(df: DataFrame, collection: str) -> list[tuple[str, str, str]]:
    def walk(kind: T.DataType, path: str) -> list[tuple[str, str, str]]:
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in walk(f.dataType, f"{path}.{f.name}" if path else f.name)]
        if isinstance(kind, T.ArrayType):
            return walk(kind.elementType, path + "[*]")
        return [(collection, path, kind.simpleString())]

    return walk(df.schema, "")


#: Characters and how N-Triples writes them.
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _unescaped(text: Column) -> Column:
    """What an N-Triples literal's text stands for: all escapes are undone in one pass, from left to right."""
    tokens = F.regexp_extract_all(text, F.lit(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\(?s:.)|[^\\]+"), F.lit(0))

    def one(t: Column) -> Column:
        code = F.decode(F.unhex(F.lpad(F.substring(t, F.lit(3), F.lit(8)), 8, "0")), "UTF-32")
        plain = F.substring(t, F.lit(2), F.lit(1))
        for mark, written in _ESCAPES.items():
            plain = F.when(t == written, F.lit(mark)).otherwise(plain)
        return F.when(~F.startswith(t, F.lit("\\")), t).when(t.rlike(r"^\\[uU][0-9A-Fa-f]{4}"), code).otherwise(plain)

    return F.array_join(F.transform(tokens, one), "")


def turtle(triples: DataFrame) -> DataFrame:
    """One N-Triples line (which Turtle readers take too) for each triple of texts; what looks like an IRI is one."""
    iri = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    text = F.col("o")
    for mark, written in _ESCAPES.items():  # the backslash first
        text = F.replace(text, F.lit(mark), F.lit(written))
    o = F.when(F.col("o").rlike(r"^[a-z][a-z0-9+.-]*:[^\s<>\"]*$"), iri(F.col("o"))).otherwise(F.concat(F.lit('"'), text, F.lit('"')))
    return triples.select(F.concat_ws(" ", iri(F.col("s")), iri(F.col("p")), o, F.lit(".")).alias("line"))


def read_ntriples(lines: DataFrame, column: str = "value") -> DataFrame:
    """Triples (s, p, o as DYNAMIC terms) from N-Triples lines; other lines are left out."""
    pattern = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*+)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*$'
    part = lambda i: F.regexp_extract(column, pattern, i)
    some = lambda c: F.when(c != "", c)
    plain = _unescaped(part(5))
    s = F.struct(F.when(F.startswith(part(1), F.lit("_:")), "bnode").otherwise("iri").alias("kind"), F.regexp_replace(part(1), "^<|>$", "").alias("value"))
    o = F.struct(
        F.when(part(3) != "", "iri").when(part(4) != "", "bnode").otherwise("literal").alias("kind"),
        F.when(part(3) != "", part(3)).when(part(4) != "", part(4)).otherwise(plain).alias("value"),
        some(part(6)).alias("datatype"),
        some(part(7)).alias("lang"),
    )
    return lines.filter(F.col(column).rlike(pattern)).select(s.alias("s"), part(2).alias("p"), o.alias("o"))
