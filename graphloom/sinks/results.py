"""Solutions and triples as JSON: typed bindings, features, legends, and order-free digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.geometry import geometry
from graphloom.functions.scalars import local_name
from graphloom.functions.terms import GEO
from graphloom.operators.solutions import Solutions

#: Properties that name a feature, the first that it has.
LABELS = ("label", "prefLabel", "name", "nameunit", "title")
PALETTE = 8


def _cell(solutions: Solutions, name: str) -> Column:
    v = solutions.vars[name]
    kind = {"iri": "uri", "bnode": "bnode", "literal": "literal"}
    if v.shape.kind == "any":
        c = v.value
        named = F.when(c["kind"] == "iri", "uri").otherwise(c["kind"])
        return F.when(c.isNotNull(), F.struct(named.alias("type"), c["value"].alias("value"), c["datatype"].alias("datatype"), c["lang"].alias("xml:lang")))
    fields = [F.lit(kind[v.shape.kind]).alias("type"), v.value.cast("string").alias("value")]
    fields += [F.lit(v.shape.datatype).alias("datatype")] if v.shape.datatype else []
    fields += [F.lit(v.shape.lang).alias("xml:lang")] if v.shape.lang else []
    return F.when(v.bound, F.struct(*fields))


def bindings(solutions: Solutions) -> DataFrame:
    """One column ``binding``: a JSON object of typed cells for each solution; unbound variables are left out."""
    return solutions.df.select(F.to_json(F.struct(*[_cell(solutions, n).alias(n) for n in solutions.vars])).alias("binding"))


def features(triples: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """From triples (s, p, o as terms): id, geometry, label, and properties (name -> values) of subjects with a geometry.

    shown: subjects (column s) to choose from; if none of them has a geometry, all subjects with one are returned.
    """
    t = triples.select(F.col("s.value").alias("s"), F.col("p.value").alias("p"), F.col("o.value").alias("o")).distinct()
    place = t.filter(F.col("p") == GEO + "hasGeometry").groupBy("s").agg(F.min("o").alias("geometry"))
    if shown is not None:
        marked = place.join(shown.select("s").distinct().withColumn("hit", F.lit(True)), "s", "left")
        any_hit = marked.agg(F.max(F.coalesce("hit", F.lit(False))).alias("any_hit"))
        place = marked.crossJoin(F.broadcast(any_hit)).filter(~F.coalesce("any_hit", F.lit(False)) | F.col("hit")).select("s", "geometry")  # one row
    rest = t.filter(F.col("p") != GEO + "hasGeometry").withColumn("name", local_name(F.col("p")))
    folded = rest.groupBy("s", "name").agg(F.array_sort(F.collect_set("o")).alias("values"))
    own = folded.groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "values")))).alias("properties"))
    label = F.coalesce(*[F.get(F.col("properties")[n], F.lit(0)) for n in LABELS], local_name(F.col("s")))
    return place.join(own, "s", "left").select(F.col("s").alias("id"), "geometry", label.alias("label"), "properties")


def _text(x: Column) -> Column:
    """A string as JSON writes it."""
    return F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")


def geometry_json(g: Column) -> Column:
    """A parsed geometry as a GeoJSON object's text; null for none."""
    pairs = lambda ring: F.transform(F.sequence(F.lit(0), (F.size(ring) / 2 - 1).cast("int")), lambda i: F.array(F.get(ring, 2 * i), F.get(ring, 2 * i + 1)))
    parts = F.transform(g["rings"], pairs)
    many, areas = F.size(g["rings"]) > 1, F.array_max(g["owner"]) > 0
    by_area = F.transform(F.sequence(F.lit(0), F.array_max(g["owner"])), lambda k: F.filter(parts, lambda _, i: F.get(g["owner"], i) == k))
    first = F.get(parts, F.lit(0))
    told = lambda kind, coordinates: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), F.to_json(coordinates), F.lit("}"))
    points = F.transform(parts, lambda p: F.get(p, F.lit(0)))
    return (
        F.when((g["kind"] == "point") & many, told("MultiPoint", points))
        .when(g["kind"] == "point", told("Point", F.get(first, F.lit(0))))
        .when((g["kind"] == "line") & many, told("MultiLineString", parts))
        .when(g["kind"] == "line", told("LineString", first))
        .when(areas, told("MultiPolygon", by_area))
        .when(g["kind"] == "area", told("Polygon", parts))
    )


def feature_json(found: DataFrame) -> DataFrame:
    """Features as GeoJSON texts: the geometry is an object (null where its text can't be read), a property of one value is
    that value, of several a list; the label is a property where no property has that name."""
    value = lambda v: F.when(F.size(v) == 1, _text(F.get(v, F.lit(0)))).otherwise(F.to_json(v))
    entry = lambda k, v: F.concat(_text(k), F.lit(":"), v)
    own = F.transform(F.map_entries(F.coalesce("properties", F.create_map().cast("map<string,array<string>>"))), lambda e: entry(e["key"], value(e["value"])))
    named = F.coalesce(F.map_contains_key("properties", "label"), F.lit(False))
    label = F.when(named | F.col("label").isNull(), F.array().cast("array<string>")).otherwise(F.array(entry(F.lit("label"), _text(F.col("label")))))
    parsed = found.withColumn("geometry", geometry(F.col("geometry")))
    place = F.coalesce(geometry_json(F.col("geometry")), F.lit("null"))
    text = F.concat(F.lit('{"type":"Feature","id":'), _text(F.col("id")), F.lit(',"geometry":'), place, F.lit(',"properties":{'), F.array_join(F.concat(own, label), ","), F.lit("}}"))
    return parsed.select(text.alias("feature"))


def legend(found: DataFrame, by: str = "class") -> DataFrame:
    """Classes with their number of features and a colour of the palette, which repeats in the labels' order."""
    counted = found.groupBy(F.col(by).alias("label")).agg(F.count(F.lit(1)).alias("features"))
    return counted.withColumn("colour", ((F.row_number().over(Window.orderBy("label")) - 1) % PALETTE).cast("int"))


def digest(frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows and a digest that doesn't depend on their order: equal bags have equal digests.

    Row digests are summed, so nothing is gathered or sorted: 128 bits of each row's SHA-256, as two sums modulo 2^64.
    """
    names = list(columns or frame.columns)
    cell = lambda n: F.concat(F.lit(f"{n}="), F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("\x00")))
    row = F.sha2(F.concat_ws("\t", *[cell(n) for n in names]), 256)
    part = lambda at: F.conv(F.substring(row, at, 12), 16, 10).cast("decimal(20,0)")
    sums = [F.coalesce(F.sum(part(at)), F.lit(0)).cast("decimal(38,0)") for at in (1, 13, 25)]
    out = frame.agg(F.count(F.lit(1)).alias("result_rows"), *[s.alias(f"s{i}") for i, s in enumerate(sums)])
    return out.select("result_rows", F.sha2(F.concat_ws(":", "result_rows", "s0", "s1", "s2"), 256).alias("result_hash"))


def sorted_digest(frame: DataFrame) -> DataFrame:
    """SHA-256 of the sorted rows' text in one task: only for results that a person would read."""
    names = frame.columns
    line = F.concat_ws("\t", *[F.concat(F.lit(f"{n}="), F.coalesce(F.col(f"`{n}`").cast("string"), F.lit(""))) for n in names])
    return frame.select(line.alias("line")).agg(F.count(F.lit(1)).alias("result_rows"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("result_hash"))
