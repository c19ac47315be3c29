"""Paged features over HTTP (a local server), JSON files, coverages, features and bindings as JSON, digests."""

from __future__ import annotations

import json
import random
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from graphloom import Const, Namespace, Ref, Solutions, Source, Template, TriplesMap, VirtualGraph
from graphloom.functions.terms import GEO, RDF_TYPE, XSD
from graphloom.operators.spatial import Relation
from graphloom.sinks import results
from graphloom.sources.coverage import coverages, raster_corners
from graphloom.sources.answers import holds, outermost
from graphloom.sources.features import FeaturesSource, fetched, publish

EX = Namespace("http://ex/")
FEATURES = [{"id": f"f{i}", "geometry": {"type": "Point", "coordinates": [i, i]}, "properties": {"name": f"n{i % 3}", "area": i * 1.5} | ({"note": "x"} if i == 4 else {})} for i in range(10)]


@pytest.fixture(scope="module")
def service():
    asked: list[dict] = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            query = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
            asked.append(query)
            if self.path.startswith("/broken"):
                self.send_error(500)
                return
            chosen = [f for f in FEATURES if "name" not in query or f["properties"]["name"] in query["name"].split("|")]
            if "bbox" in query:
                x0, y0, x1, y1 = map(float, query["bbox"].split(","))
                chosen = [f for f in chosen if x0 <= f["geometry"]["coordinates"][0] <= x1 and y0 <= f["geometry"]["coordinates"][1] <= y1]
            at, limit = int(query.get("offset", 0)), int(query.get("limit", 4))
            links = [{"rel": "self", "href": self.path}]
            if at + limit < len(chosen):
                links.append({"rel": "next", "href": "/items?" + urllib.parse.urlencode(query | {"offset": at + limit, "limit": limit})})
            told = {"numberMatched": len(chosen)} if self.path.startswith("/counted") else {}
            body = json.dumps({"features": chosen[at : at + limit], "links": links} | told).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def reader(spark, url, **options):
    spark.dataSource.register(FeaturesSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("features").schema("id string, geometry string, name string, area double, note string").options(url=url, **options)


def test_next_links(spark, service):
    rows = reader(spark, service[0] + "/items").load().collect()
    assert [r.id for r in rows] == [f["id"] for f in FEATURES]
    assert [r.note for r in rows].count("x") == 1 and rows[4].note == "x"  # a feature without a property shifts nothing
    assert json.loads(rows[3].geometry)["coordinates"] == [3, 3]


def test_pages_in_parallel(spark, service):
    df = reader(spark, service[0] + "/items", limit="3", total="10").load()
    assert df.rdd.getNumPartitions() == 4
    assert sorted(r.id for r in df.collect()) == sorted(f["id"] for f in FEATURES)


def test_pushed_filter(spark, service):
    url, asked = service
    del asked[:]
    rows = reader(spark, url + "/items", push="name=name").load().filter(F.col("name") == "n1").collect()
    assert {r.id for r in rows} == {"f1", "f4", "f7"} and all(q.get("name") == "n1" for q in asked) and asked


def _remote(spark, url, **options):
    things = TriplesMap("thing", Source.features("items", url + "/items", "id string, geometry string, name string, area double"), Template("http://ex/thing/{id}"), ((EX.name, Ref("name")), (EX.area, Ref("area", XSD + "double")), (GEO + "hasGeometry", Ref("geometry", GEO + "geoJSONLiteral"))), (EX.Thing.value,), True, ((EX.name, "name"), (GEO + "hasGeometry", "bbox")))
    near = TriplesMap("near", Source.frame("near", lambda s: s.createDataFrame([(1, "n1", "POLYGON((3 3, 6 3, 6 6, 3 6, 3 3))"), (2, "n1", "POLYGON((4 4, 5 4, 5 5, 4 5, 4 4))"), (3, "n9", "POLYGON((50 50, 51 50, 51 51, 50 51, 50 50))")], "k long, name string, wkt string")), Template("http://ex/near/{k}"), ((EX.called, Ref("name")), (GEO + "hasGeometry", Ref("wkt", GEO + "wktLiteral"))), (EX.Near.value,), True)
    return VirtualGraph(spark, [things, near], **options)


def test_constants_reach_a_service(spark, service):
    url, asked = service
    del asked[:]
    rows = _remote(spark, url).match(("?t", EX.name, "n1"), ("?t", EX.area, "?area")).frame().collect()
    assert {r.t for r in rows} == {"http://ex/thing/f1", "http://ex/thing/f4", "http://ex/thing/f7"}
    assert asked and all(q.get("name") == "n1" for q in asked)


def test_values_reach_a_service(spark, service):
    """The solutions so far ask a remote source: one request for each value, none for everything."""
    url, asked = service
    pattern = [("?k", EX.called, "?name"), ("?k", Const(RDF_TYPE), EX.Near), ("?t", EX.name, "?name"), ("?t", EX.area, "?area")]
    wanted = {(f"http://ex/near/{k}", f"http://ex/thing/f{i}") for k in (1, 2) for i in (1, 4, 7)}
    del asked[:]
    rows = _remote(spark, url).match(*pattern).frame().collect()
    assert {(r.k, r.t) for r in rows} == wanted and len(rows) == 6
    assert sorted(q.get("name") for q in asked) == ["n1", "n9"]


def test_values_are_asked_for_together(spark, service):
    """A service that takes lists is asked for many values at once."""
    url, asked = service
    del asked[:]
    remote = Source.features("items", url + "/items", "id string, name string", many="2", between="|", limit="20").remote
    keys = spark.createDataFrame([(n, {"name": n}) for n in ("n0", "n1", "n2", "n7", "n8")], "key string, ask map<string,string>").withColumn("key", F.lit("one task"))
    got = remote.answers(keys, {"name": "name"}).collect()
    assert sorted(r.id for r in got) == sorted(f["id"] for f in FEATURES)
    assert sorted(len(q["name"].split("|")) for q in asked) == [1, 2, 2] and len({v for q in asked for v in q["name"].split("|")}) == 5


def test_a_constant_box_reaches_a_service(spark, service):
    url, asked = service
    del asked[:]
    inside = Relation("g", predicate="within", constant="POLYGON((2 2, 5 2, 5 5, 2 5, 2 2))")
    found = _remote(spark, url).match(("?t", EX.area, "?area"), ("?t", Const(GEO + "hasGeometry"), "?g"), where=[inside]).select("t").frame().collect()
    assert {r.t for r in found} == {"http://ex/thing/f3", "http://ex/thing/f4"}
    assert {q.get("bbox") for q in asked} == {"2.0,2.0,5.0,5.0"}


def test_requests_inside_earlier_ones_are_not_sent(spark, service):
    url, asked = service
    g = _remote(spark, url)
    box = lambda a, b: [Relation("g", predicate="within", constant=f"POLYGON(({a} {a}, {b} {a}, {b} {b}, {a} {b}, {a} {a}))")]
    star = [("?t", EX.area, "?area"), ("?t", Const(GEO + "hasGeometry"), "?g")]

    def sent(*patterns, **options):
        del asked[:]
        rows = g.match(*patterns, **options).select("t").frame().distinct().collect()
        return len({json.dumps(q) for q in asked if "offset" not in q}), len(rows)

    assert sent(*star, where=box(1, 7)) == (1, 5)
    assert sent(*star, where=box(2, 6)) == (0, 3)  # inside the first
    assert sent(*star, where=box(5, 9)) == (1, 3)  # across its edge
    called = [("?k", EX.called, "?name"), ("?t", EX.name, "?name"), ("?t", EX.area, "?area")]
    assert sent(*called) == (2, 3) and sent(*called) == (0, 3)
    assert sent(("?t", EX.name, "n1"), ("?t", EX.area, "?area")) == (1, 3)  # a constant of a new kind
    assert sent(("?t", EX.name, "n1"), ("?t", EX.area, "?area")) == (0, 3)
    assert sent(("?t", EX.area, "?area")) == (1, 10)  # everything
    assert sent(*star, where=box(0, 99)) == (0, 9) and sent(*called) == (0, 3)
    g.answers.forget()
    assert sent(*called) == (2, 3)


def test_outermost_boxes(spark):
    rng = random.Random(8)
    made = set()
    for _ in range(150):
        x, y, w, h = rng.randint(-40, 40), rng.randint(-40, 40), rng.choice((0, 1, 3, 9, 30)), rng.choice((0, 1, 3, 9, 30))
        made.add((float(x), float(y), float(x + w), float(y + h)))
    kind = "b struct<xmin: double, ymin: double, xmax: double, ymax: double>"
    some = sorted(made)[::3]
    left = [b for b in made if b not in some]
    for earlier, boxes in ((None, sorted(made)), (some, left)):
        had = None if earlier is None else spark.createDataFrame([(b,) for b in earlier], kind)
        got = {tuple(r.b) for r in outermost(spark.createDataFrame([(b,) for b in boxes], kind), had).collect()}
        assert got == {b for b in boxes if not any(a != b and holds(a, b) for a in [*boxes, *(earlier or ())])}


def test_pages_by_what_a_service_counts(spark, service):
    """Pages are read in parallel without a typed total."""
    url, asked = service
    del asked[:]
    df = reader(spark, url + "/counted", limit="3").load()
    assert df.rdd.getNumPartitions() == 4
    del asked[:]
    assert sorted(r.id for r in df.collect()) == sorted(f["id"] for f in FEATURES)
    assert {q.get("offset") for q in asked} >= {"0", "3", "6", "9"}


def test_a_failed_request_is_made_again(spark, service):
    url, asked = service
    del asked[:]
    with pytest.raises(OSError):
        fetched(url + "/broken", {"retries": "2"})
    assert len(asked) == 3 and fetched(url + "/broken", {"retries": "0", "on_error": "empty"}) is None


def test_a_published_folder_answers(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i % 5}", i * 1.5, None if i == 3 else "é") for i in range(40)], "i long, name string, area double, note string")
    url = publish(rows, str(tmp_path / "a b"), "name", "i", buckets=4)
    assert sorted(f["id"] for f in fetched(url + "?name=n3", {})["features"]) == sorted(str(i) for i in range(3, 40, 5))
    assert fetched(url + "?limit=7&offset=35", {})["numberMatched"] == 40 and len(fetched(url + "?limit=7&offset=35", {})["features"]) == 5
    assert fetched(url + "?name=nothing", {})["features"] == []
    spark.dataSource.register(FeaturesSource)
    read = spark.read.format("features").schema("id string, i long, name string, area double").options(url=url, limit="11").load()
    assert read.rdd.getNumPartitions() == 4 and read.agg(F.sum("area")).first()[0] == sum(i * 1.5 for i in range(40))


def test_a_published_folder_reads_little_for_a_value(spark, tmp_path, monkeypatch):
    """A value's features are found by halving its bucket, so what is read hardly grows with the folder."""
    parsed = []
    loads = json.loads
    for n, folder in ((400, "a"), (8000, "b")):
        rows = spark.range(n).select(F.col("id").alias("i"), (F.col("id") % (n // 4)).alias("k"), F.repeat(F.lit("é"), (F.col("id") % 50).cast("int")).alias("note"))
        url = publish(rows.union(spark.createDataFrame([(-1, None, "no key")], rows.schema)), str(tmp_path / folder), "k", "i", buckets=3)
        monkeypatch.setattr("graphloom.sources.features.json.loads", lambda line: parsed.append(1) or loads(line))
        values = [0, 1, 7, 50, n // 4 - 1]
        del parsed[:]
        got = fetched(url + "?between=|&k=" + "|".join(map(str, [*values, n, "None"])), {})["features"]
        assert len(parsed) == 4 * len(values)
        monkeypatch.undo()
        assert sorted(int(f["id"]) for f in got) == sorted(v + j * (n // 4) for v in values for j in range(4))
        assert all(f["properties"]["note"] == "é" * (int(f["id"]) % 50) and set(f) == {"type", "id", "properties"} for f in got)
        every = [fetched(f"{url}?k={v}", {})["features"] for v in range(0, n // 4, 7)]
        assert [sorted(int(f["id"]) for f in fs) for fs in every] == [[v + j * (n // 4) for j in range(4)] for v in range(0, n // 4, 7)]
        assert {f["id"] for f in fetched(url, {})["features"]} == {str(i) for i in range(-1, n)}


def test_boxes_reach_a_service(spark, service):
    """Boxes that lie in others aren't asked for."""
    url, asked = service
    del asked[:]
    pattern = [("?k", Const(RDF_TYPE), EX.Near), ("?k", Const(GEO + "hasGeometry"), "?gk"), ("?t", Const(RDF_TYPE), EX.Thing), ("?t", Const(GEO + "hasGeometry"), "?gt")]
    rows = _remote(spark, url, seed=1).match(*pattern, where=[Relation("gk", "gt", "intersects")]).select("k", "t").frame().collect()
    assert {(r.k, r.t) for r in rows} == {("http://ex/near/1", f"http://ex/thing/f{i}") for i in (3, 4, 5, 6)} | {("http://ex/near/2", f"http://ex/thing/f{i}") for i in (4, 5)}
    assert {q.get("bbox") for q in asked} == {"3.0,3.0,6.0,6.0", "50.0,50.0,51.0,51.0"}


def test_failures(spark, service):
    with pytest.raises(Exception):  # noqa: B017
        reader(spark, service[0] + "/broken").load().collect()
    assert reader(spark, service[0] + "/broken", on_error="empty").load().collect() == []


def test_json_files(spark, tmp_path):
    page = {"features": [{"id": "a", "properties": {"name": "x", "tags": ["p", "q", "p"]}}, {"id": "b", "properties": {"name": None, "tags": []}}]}
    (tmp_path / "page.json").write_text(json.dumps(page))
    source = Source.json("page", str(tmp_path), "features array<struct<id: string, properties: struct<name: string, tags: array<string>>>>", "$.features.*")
    g = VirtualGraph(spark, [TriplesMap("f", source, Template("http://ex/f/{id}"), ((EX.name, Ref("properties.name")), (EX.tag, Ref("properties.tags[*]"))), (EX.F.value,), True)])
    assert {tuple(r) for r in g.match(("?f", Const(RDF_TYPE), EX.F)).frame().collect()} == {("http://ex/f/a",), ("http://ex/f/b",)}
    assert sorted(map(tuple, g.match(("?f", EX.tag, "?t")).frame().collect())) == [("http://ex/f/a", "p"), ("http://ex/f/a", "q")]
    assert g.match(("?f", EX.name, "?n")).frame().count() == 1  # null is no triple


def test_coverages(spark):
    boxes = spark.createDataFrame([(1, (0.0, 1.0, 2.0, 3.0)), (2, (5.0, 5.0, 5.0, 5.0))], "i int, box struct<xmin: double, ymin: double, xmax: double, ymax: double>")
    made = coverages(boxes, "http://wcs/?service=WCS", parameters={"COVERAGE": "x"}).withColumn("corners", raster_corners(F.col("coverage"), F.col("box"))).orderBy("i").collect()
    assert made[0].coverage == "http://wcs/?service=WCS&BBOX=1.0,0.0,3.0,2.0&COVERAGE=x"
    assert made[0].corners == [[0, 3], [2, 3], [2, 1], [0, 1]]
    assert "4.99,4.99,5.01,5.01" in made[1].coverage
    assert boxes.select(raster_corners(F.lit("http://other/"), F.col("box")).alias("c")).first().c is None
    with pytest.raises(Exception):  # noqa: B017
        coverages(boxes.withColumn("box", F.lit(None).cast(boxes.schema["box"].dataType)), "http://wcs/").collect()


def places(spark):
    rows = spark.createDataFrame([(1, "POINT(1 2)", "One"), (2, "POINT(3 4)", None), (3, None, "Three")], "id int, wkt string, title string")
    return VirtualGraph(spark, [TriplesMap("p", Source.frame("p", lambda _: rows), Template("http://ex/p/{id}"), ((GEO + "hasGeometry", Ref("wkt", GEO + "wktLiteral")), (EX.title, Ref("title", lang="en"))), (EX.P.value,), True)])


def test_features(spark):
    t = places(spark).triples()
    got = {r.id: (r.geometry, r.label) for r in results.features(t).collect()}
    assert got == {"http://ex/p/1": ("POINT(1 2)", "One"), "http://ex/p/2": ("POINT(3 4)", "2")}
    shown = spark.createDataFrame([("http://ex/p/2",)], "s string")
    assert [r.id for r in results.features(t, shown).collect()] == ["http://ex/p/2"]
    none = spark.createDataFrame([("http://ex/p/3",)], "s string")
    assert results.features(t, none).count() == 2  # nothing shown has a place: all that have one
    texts = [json.loads(r.feature) for r in results.feature_json(results.features(t)).collect()]
    assert all(x["type"] == "Feature" for x in texts)


def test_bindings(spark):
    g = places(spark)
    found = g.match(("?p", Const(RDF_TYPE), EX.P)).optional(g.match(("?p", EX.title, "?t")))
    got = sorted((json.loads(r.binding) for r in results.bindings(found).collect()), key=lambda b: b["p"]["value"])
    assert got[0] == {"p": {"type": "uri", "value": "http://ex/p/1"}, "t": {"type": "literal", "value": "One", "xml:lang": "en"}}
    assert "t" not in got[1]
    mixed = results.bindings(g.match(("?p", "?q", "?o")))
    assert mixed.count() == 3 + 2 + 2
    typed = Solutions.values(spark, ["x"], [[Const.literal(5)]])
    assert json.loads(results.bindings(typed).first().binding)["x"] == {"type": "literal", "value": "5", "datatype": XSD + "integer"}


def test_digests(spark):
    rows = [(i % 5, f"x{i % 7}") for i in range(100)]
    one, two = spark.createDataFrame(rows, "a int, b string"), spark.createDataFrame(rows[::-1], "a int, b string").repartition(3)
    assert results.digest(one).first() == results.digest(two).first()
    assert results.digest(one).first() != results.digest(spark.createDataFrame(rows[1:], "a int, b string")).first()
    assert results.sorted_digest(one).first() == results.sorted_digest(two).first()
    assert results.digest(one.limit(0)).first().result_rows == 0
