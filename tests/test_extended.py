"""Chains of rules, JSON against a schema, escapes, discovery, run logs, stored indexes, collections, features as texts."""

from __future__ import annotations

import json
import random
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import Namespace, Ref, Source, Template, TriplesMap
from graphloom.annotate import align, discover, generate
from graphloom.functions import geodesy, validation
from graphloom.functions.geometry import geometry
from graphloom.operators import runs, vectors
from graphloom.plans.rules import candidates
from graphloom.sinks import results
from graphloom.sources.features import CollectionsSource
from graphloom.sources.mapping import rules_of

EX = Namespace("http://ex/")


def rules(*told):
    """Rules of maps (name, subject, predicate, object); templates by their prefix."""
    at = lambda x: Template(f"http://{x}/{{k}}") if x else Ref("k", kind="iri")
    return rules_of([TriplesMap(n, Source.frame(n, lambda s: s.range(1)), at(s), ((p, at(o)),)) for n, s, p, o in told])


def test_rules_that_agree_in_pairs_only():
    """Three patterns in a ring: each rule has a partner in each other pattern, but no three go together."""
    found = rules(("1", "a", EX.p, "b"), ("2", "c", EX.p, "d"), ("3", "b", EX.q, "e"), ("4", "d", EX.q, "f"), ("5", "e", EX.r, "c"), ("6", "f", EX.r, "a"))
    ring = [("?x", EX.p, "?y"), ("?y", EX.q, "?z"), ("?z", EX.r, "?x")]
    assert candidates(ring, found) == [[], [], []]
    more = rules(("1", "a", EX.p, "b"), ("2", "c", EX.p, "d"), ("3", "b", EX.q, "e"), ("4", "d", EX.q, "f"), ("5", "e", EX.r, "c"), ("6", "f", EX.r, "a"), ("7", "e", EX.r, "a"))
    assert [[r.map.name for r in part] for part in candidates(ring, more)] == [["1"], ["3"], ["7"]]
    anything = rules(("1", "a", EX.p, "b"), ("2", "b", EX.q, ""), ("3", "", EX.r, "a"))  # an object of any IRI
    assert [len(part) for part in candidates(ring, anything)] == [1, 1, 1]
    assert [len(p) for p in candidates([("?x", EX.p, "?x")], rules(("1", "a", EX.p, "b"), ("2", "a", EX.p, "a")))] == [1]


def plainly(value, schema, path="$"):
    """The first fault, in plain Python."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    kind = schema.get("type")
    good = not kind or (isinstance(value, (int, float)) and not isinstance(value, bool) if kind == "number" else isinstance(value, int) and not isinstance(value, bool) if kind == "integer" else isinstance(value, kinds[kind]))
    if not good:
        return f"{path} must be a JSON {kind}."
    if kind == "object":
        if missing := [k for k in schema.get("required", []) if k not in value]:
            return f"{path} is missing required field(s): {', '.join(missing)}."
        if schema.get("additionalProperties") is False and (more := sorted(set(value) - set(schema.get("properties", {})))):
            return f"{path} has unexpected field(s): {', '.join(more)}."
        for k, own in schema.get("properties", {}).items():
            if k in value and (found := plainly(value[k], own, f"{path}.{k}")):
                return found
    if kind == "array":
        for i, x in enumerate(value):
            if found := plainly(x, schema.get("items", {}), f"{path}[{i}]"):
                return found
    if "enum" in schema and value not in schema["enum"]:
        return f"{path} must be one of: {', '.join(map(str, schema['enum']))}."
    return None


def test_json_against_a_schema(spark):
    schema = {"type": "object", "required": ["name", "parts"], "additionalProperties": False, "properties": {"name": {"type": "string"}, "kind": {"enum": ["a", "é"]}, "n": {"type": "integer"}, "x": {"type": "number"}, "flag": {"type": "boolean"}, "none": {"type": "null"}, "parts": {"type": "array", "items": {"type": "object", "required": ["id"], "properties": {"id": {"type": "string"}, "tags": {"type": "array", "items": {"type": "string"}}}}}}}
    good = {"name": "x", "kind": "é", "n": 3, "x": 1.5, "flag": False, "none": None, "parts": [{"id": "p", "tags": ["t"]}, {"id": "q", "other": 1}]}
    cases = [good, [], "text", 4, None, {}, {"name": "x"}, good | {"zz": 1, "aa": 2}, good | {"name": 1}, good | {"kind": "b"}, good | {"n": 1.5}, good | {"x": "1"}, good | {"flag": 0}, good | {"none": 0}, good | {"parts": {}}, good | {"parts": []}]
    cases += [good | {"parts": [{"id": "p"}, {"id": 2}]}, good | {"parts": [{"id": "p", "tags": ["t", None]}]}, good | {"parts": [{}]}, good | {"name": ""}]
    df = spark.createDataFrame([(i, json.dumps(c, ensure_ascii=False)) for i, c in enumerate(cases)] + [(98, "{broken"), (99, None)], "i int, t string")
    got = {r.i: r.f for r in df.select("i", validation.fault(F.try_parse_json("t"), schema).alias("f")).collect()}
    assert got.pop(98) == got.pop(99) == "$ is no JSON."
    assert got == {i: plainly(c, schema) for i, c in enumerate(cases)}
    assert spark.range(1).select(validation.fault_path(F.lit("$.parts[1].id must be a JSON string.")).alias("p")).first().p == "$.parts[1].id"


def test_rasters(spark):
    corners = [[0, 1], [2, 1], [2, 0.5], [0, 0.5]]
    cases = {json.dumps({"image": "u", "corners": corners}): True, json.dumps({"image": "u", "corners": corners[:3]}): False, json.dumps({"corners": corners}): False, json.dumps({"image": "u", "corners": [[0, 1, 2]] * 4}): False, json.dumps({"image": "u", "corners": [["a", "b"]] * 4}): False, "text": False, None: False}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", validation.is_raster(F.col("t")).alias("r"))
    assert {r.t: r.r for r in df.collect()} == cases


def test_escapes_come_back(spark):
    texts = ["a\\nb", "a\nb", '"quoted" \\', "tab\tret\rbell\b\f", "\\u0041", "é 😀", "", "\\\\n\\", "x" * 100_000 + '"' * 5000, "  \x85"]
    triples = spark.createDataFrame([(f"http://ex/{i}", "http://ex/p", t) for i, t in enumerate(texts)], "s string, p string, o string")
    lines = generate.turtle(triples)
    assert not any("\n" in r.line or "\r" in r.line for r in lines.collect())
    again = {r.s["value"]: r.o["value"] for r in generate.read_ntriples(lines.withColumnRenamed("line", "value")).collect()}
    assert again == {f"http://ex/{i}": t for i, t in enumerate(texts)}
    written = spark.createDataFrame([(r'<http://ex/s> <http://ex/p> "A\U0001F600 \' \\u0041"@en .',)], "value string")
    found = generate.read_ntriples(written).first().o
    assert (found["value"], found["lang"]) == ("A😀 ' \\u0041", "en")


def test_lists_and_collections(spark):
    rdf, owl, rdfs = discover.RDF, discover.OWL, discover.RDFS
    told = [("http://ex/A", rdfs + "subClassOf", "http://www.opengis.net/ont/geosparql#Feature"), ("http://ex/A", rdfs + "label", "Alpha"), ("http://ex/B", rdf + "type", owl + "Class"), ("http://ex/B", owl + "equivalentClass", "http://s/B"), ("http://ex/X_collection", rdf + "type", owl + "Class"), ("http://other/C", rdf + "type", owl + "Class")]
    told += [("http://ex/p", rdf + "type", rdf + "Property"), ("http://ex/p", rdfs + "domain", "_:u"), ("_:u", owl + "unionOf", "_:l0"), ("http://ex/q", rdf + "type", owl + "DatatypeProperty"), ("http://ex/q", rdfs + "domain", "http://ex/A"), ("http://ex/q", rdfs + "range", "http://www.w3.org/2001/XMLSchema#float"), ("http://other/r", rdf + "type", rdf + "Property"), ("http://other/r", rdfs + "domain", "http://ex/A"), ("http://ex/untyped", rdfs + "domain", "http://ex/A")]
    n = 70  # a long list, with both classes in it
    for i in range(n):
        item = {3: "http://ex/A", n - 1: "http://ex/B"}.get(i, f"http://else/{i}")
        told += [(f"_:l{i}", rdf + "first", item), (f"_:l{i}", rdf + "rest", f"_:l{i + 1}" if i < n - 1 else rdf + "nil")]
    triples = spark.createDataFrame(told, "s string, p string, o string")
    assert discover.members(triples, spark.createDataFrame([("_:l0",)], "head string")).count() == n
    got = {tuple(r) for r in discover.collections(triples, "http://ex/").select("cls", "title", "equivalent", "property", "type").collect()}
    assert got == {("http://ex/A", "Alpha", None, "http://ex/p", "string"), ("http://ex/A", "Alpha", None, "http://ex/q", "number"), ("http://ex/B", "B", "http://s/B", "http://ex/p", "string")}
    texts = {r.iri: r.text for r in discover.entity_texts(triples).collect()}
    assert texts["http://ex/B"] == "Class: B. Label: . Description: ." and "http://ex/p" not in texts
    chosen = spark.createDataFrame([("http://ex/p", "http://s/p", "local"), ("http://ex/A", "http://s/A", "baseline")], "local string, accepted string, source string")
    found = discover.collections(triples, "http://ex/")
    one, two = ({r.cls: r.report for r in discover.report(f, chosen).collect()} for f in (found, found.repartition(3, "property")))
    assert one == two and set(one) == {"http://ex/A", "http://ex/B"}
    about = json.loads(one["http://ex/A"])
    assert about["statistics"] == {"properties": 2, "aligned": 1} and about["decision"]["accepted"] == "http://s/A" and [p["property"] for p in about["properties"]] == ["http://ex/p", "http://ex/q"]


def test_a_log_that_is_resumed(spark, tmp_path):
    log = runs.RunLog(spark, str(tmp_path / "log"), "query_id string, execution_order int, status string")
    row = lambda *r: spark.createDataFrame(list(r), log.schema)
    assert log.version() == 0 and log.read().collect() == []
    log.append(row(("a", 1, "success"), ("b", 2, "failed"), ("c", 3, "success")))
    log.append(row(("c", 4, "success"), ("c", 4, "success")))
    row(("half", 9, "success")).write.parquet(f"{log.path}/version=1")  # a crash before the manifest was written
    assert log.version() == 0 and log.read().count() == 5
    assert sorted(map(tuple, log.resume(["query_id"]).collect())) == [("a", 1, "success"), ("c", 4, "success")]
    log.append(row(("b", 5, "success")))
    assert log.version() == 1 and log.read().count() == 3 and log.at(0).count() == 5  # the archive
    assert log.resume(["query_id"], F.col("query_id") != "a").count() == 2 and log.version() == 2


def test_a_stored_index_is_exact_and_read_again(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 12)) * 4
    table = [(i, (centres[i % 6] + rng.standard_normal(12) * 0.3).tolist()) for i in range(600)] + [(1000, None), (1001, [1.0, None]), (1002, [0.0] * 12), (1003, centres[0].tolist()), (1004, centres[0].tolist())]
    entities = spark.createDataFrame(table, "entity int, embedding array<double>")
    terms = entities.filter("entity % 40 = 0 OR entity > 1000").withColumnRenamed("entity", "term")
    path = str(tmp_path / "index")
    wanted = sorted(map(tuple, vectors.nearest(terms, entities, k=4, threshold=0.2).collect()))
    index = vectors.stored_index(entities, path, size=16)
    assert sorted(map(tuple, vectors.nearest_in(index, terms, k=4, threshold=0.2).collect())) == wanted and len(wanted) > 40
    again = vectors.stored_index(entities.filter(F.raise_error(F.lit("read")).isNull()), path)  # the vectors aren't read
    assert sorted(map(tuple, vectors.nearest_in(again, terms, k=4, threshold=0.2).collect())) == wanted


def test_vectors_that_are_alike_give_no_more_than_k(spark):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(300)], "entity int, embedding array<double>")
    got = vectors.nearest(same.filter("entity < 3").withColumnRenamed("entity", "term"), same, k=2).collect()
    assert sorted((r.term, r["rank"], r.entity) for r in got) == [(t, r, r - 1) for t in range(3) for r in (1, 2)]
    i, j, _ = vectors._best(np.ones((5, 300)), list(range(300)), 2, 0.5)
    assert len(i) == 10 and set(j.tolist()) == {0, 1}


def test_collections_in_two_levels(spark):
    held = {"a": 7, "b c": 3, "d": 0}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            parts = urllib.parse.urlsplit(self.path)
            query = dict(urllib.parse.parse_qsl(parts.query))
            if parts.path == "/collections":
                body = {"collections": [{"id": k, "description": "x"} | ({"title": "T", "extent": {"spatial": {"bbox": [1]}}} if k == "a" else {}) for k in held]}
            else:
                name = urllib.parse.unquote(parts.path.split("/")[2])
                at, limit = int(query.get("offset", 0)), int(query["limit"])
                body = {"numberMatched": held[name], "features": [{"id": f"{name}{i}", "properties": {"i": i}} for i in range(held[name])][at : at + limit]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(CollectionsSource)
    read = lambda **o: spark.read.format("collections").options(url=url, **o)
    assert {tuple(r) for r in read().load().collect()} == {("a", "T", "x", '{"bbox": [1]}'), ("b c", "b c", "x", None), ("d", "d", "x", None)}
    items = read(items="true", limit="2").schema("collection string, id string, i long").load()
    assert items.rdd.getNumPartitions() == 4 + 2  # pages of a and of b c, read in parallel
    assert sorted(map(tuple, items.collect())) == sorted((k, f"{k}{i}", i) for k, n in held.items() for i in range(n))
    assert read(select="a,d").load().count() == 2
    server.shutdown()


@pytest.mark.parametrize(
    ("text", "kind", "coordinates"),
    [
        ("POINT(1 2)", "Point", [1, 2]),
        ("MULTIPOINT(1 2, 3 4)", "MultiPoint", [[1, 2], [3, 4]]),
        ("LINESTRING(1 2, 3 4)", "LineString", [[1, 2], [3, 4]]),
        ("MULTILINESTRING((1 2, 3 4), (5 6, 7 8))", "MultiLineString", [[[1, 2], [3, 4]], [[5, 6], [7, 8]]]),
        ("POLYGON((0 0, 9 0, 9 9, 0 0), (2 1, 3 1, 3 2, 2 1))", "Polygon", [[[0, 0], [9, 0], [9, 9], [0, 0]], [[2, 1], [3, 1], [3, 2], [2, 1]]]),
        ("MULTIPOLYGON(((0 0, 9 0, 9 9, 0 0)), ((20 0, 29 0, 29 9, 20 0)))", "MultiPolygon", [[[[0, 0], [9, 0], [9, 9], [0, 0]]], [[[20, 0], [29, 0], [29, 9], [20, 0]]]]),
    ],
)
def test_geometries_as_objects(spark, text, kind, coordinates):
    made = spark.createDataFrame([(text,)], "t string").withColumn("p", geometry("t")).select(results.geometry_json(F.col("p")).alias("g")).first().g
    assert json.loads(made) == {"type": kind, "coordinates": coordinates}


def test_features_as_texts(spark):
    rows = [("http://ex/1", "POINT(1 2)", 'A "b"\n', {"name": ["x"], "many": ["p", "q"]}), ("http://ex/2", "nothing", "L", {"label": ["own"]}), ("http://ex/3", None, None, None)]
    df = spark.createDataFrame(rows, "id string, geometry string, label string, properties map<string,array<string>>")
    got = [json.loads(r.feature) for r in results.feature_json(df).collect()]
    assert got[0] == {"type": "Feature", "id": "http://ex/1", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"name": "x", "many": ["p", "q"], "label": 'A "b"\n'}}
    assert got[1]["geometry"] is None and got[1]["properties"] == {"label": "own"} and got[2]["properties"] == {}


def test_many_random_chains():
    """Every rule that is kept stands in a chain, and every chain is kept."""
    rng = random.Random(3)
    for _ in range(60):
        names = "abc"
        found = rules(*[(str(i), rng.choice(names), rng.choice((EX.p, EX.q, EX.r)), rng.choice(names)) for i in range(9)])
        pattern = [("?x", EX.p, "?y"), (rng.choice(("?y", "?x")), EX.q, "?z"), ("?z", EX.r, rng.choice(("?x", "?w")))]
        of = lambda p: [r for r in found if r.predicate == p.value]
        name = lambda t: t.text if hasattr(t, "text") else str(t)
        chains = []
        for chosen in [(a, b, c) for a in of(EX.p) for b in of(EX.q) for c in of(EX.r)]:
            held = {}
            if all(held.setdefault(v, name(t)) == name(t) for p, r in zip(pattern, chosen, strict=True) for v, t in ((p[0], r.map.subject), (p[2], r.object))):
                chains.append(chosen)
        wanted = [{r.map.name for r in (c[i] for c in chains)} for i in range(3)]
        assert [{r.map.name for r in part} for part in candidates(pattern, found)] == wanted


def test_buffers_and_distances_in_a_plane(spark):
    rows = [("SRID=25830;POINT(500000 4000000)", "SRID=25830;POINT(500300 4000400)"), ("POINT(0 0)", "POINT(0 1)"), ("SRID=4258;POINT(0 0)", "SRID=4258;POINT(0 1)"), ("SRID=25830;POINT(1 1)", "SRID=25831;POINT(1 1)")]
    df = spark.createDataFrame(rows, "a string, b string").withColumns({"p": geometry("a"), "q": geometry("b")})
    box = F.struct(*[F.col("p")[c].alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    wide = geodesy.buffered(box, F.lit(100.0), F.col("p.srid"))
    got = {r.a: r for r in df.select("a", geodesy.distance(F.col("p"), F.col("q")).alias("d"), wide.alias("w"), geodesy.buffered(box, F.lit(100.0), F.col("p.srid"), 0.3048).alias("f")).collect()}
    flat = got["SRID=25830;POINT(500000 4000000)"]
    assert flat.d == pytest.approx(500) and tuple(flat.w) == (499900, 3999900, 500100, 4000100) and flat.f.xmax == pytest.approx(500000 + 100 / 0.3048)
    for a in ("POINT(0 0)", "SRID=4258;POINT(0 0)"):
        assert 110_000 < got[a].d < 111_000 and 0.0008 < got[a].w.xmax < 0.001


def test_ontologies_with_comments_and_boxes(spark):
    rows = spark.createDataFrame([("rivers", "name", "string", "Rivers", "All of them", "0,1,2,3", "http://crs/84"), ("rivers", "length", "number", "Rivers", "All of them", "0,1,2,3", "http://crs/84"), ("lakes", "name", "string", "Lakes", None, None, None)], "collection string, property string, type string, title string, description string, bbox string, crs string")
    got = {tuple(r) for r in generate.ontology(rows, "http://ex/").collect()}
    of = lambda s, p: {o for a, b, o in got if a == s and b.endswith(p)}
    assert of("http://ex/rivers", "label") == {"Rivers"} and of("http://ex/rivers", "comment") == {"All of them"} and of("http://ex/lakes", "comment") == set()
    (node,) = of("http://ex/rivers_collection", "hasBoundingBox")
    assert of(node, "asWKT") == {"<http://crs/84> POLYGON((0.0 1.0, 2.0 1.0, 2.0 3.0, 0.0 3.0, 0.0 1.0))"}
    assert of("http://ex/name", "domain") == {"http://ex/rivers", "http://ex/lakes"} and not of("http://ex/lakes_collection", "hasBoundingBox")
    sample = discover.samples(generate.ontology(rows, "http://ex/"), {"property": 1}).collect()
    assert {(r.kind, r.iri) for r in sample} == {("class", "http://ex/lakes"), ("class", "http://ex/rivers"), ("class", "http://www.opengis.net/ont/geosparql#Feature"), ("property", "http://ex/length")} | {("entity", x) for x in ("http://ex/lakes", "http://ex/rivers", "http://ex/name", "http://ex/length", "http://www.opengis.net/ont/geosparql#Feature")}


def test_mappings_aligned_again():
    m = TriplesMap("m", Source.frame("m", lambda s: s.range(1)), Template("http://ex/m/{id}"), (("http://s/name", Ref("id")), ("http://ex/x", Ref("id"))), ("http://s/Old",))
    (again,) = align.rewritten([m], {"http://ex/name": "http://t/label", "http://ex/x": "http://t/x"}, {"http://ex/name": "http://s/name", "http://ex/C": "http://s/Old"})
    assert [p for p, _ in again.objects] == ["http://t/label", "http://t/x"] and again.classes == ("http://ex/C",)


@pytest.mark.parametrize("stored", [True, False])
def test_tiles_are_never_broadcast(spark, tmp_path, stored):
    """Copies of the terms' tiles, one for each group, would go through the driver."""
    entities = spark.range(64).select(F.col("id").alias("entity"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    terms = entities.withColumnRenamed("entity", "term")
    found = vectors.nearest_in(vectors.stored_index(entities, str(tmp_path / "index")), terms) if stored else vectors.nearest(terms, entities)
    assert found.count()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
