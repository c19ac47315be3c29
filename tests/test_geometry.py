"""Parsing, exact predicates, distances and boxes."""

from __future__ import annotations

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import geodesy
from graphloom.functions import geometry as geo
from graphloom.functions import shapes
from graphloom.functions.geometry import parse


def rel(a: str, b: str) -> set[str]:
    return {k for k, v in shapes.relations([parse(a)], [parse(b)]).items() if v[0]}


def box(x, y, w, h):
    return f"POLYGON(({x} {y}, {x + w} {y}, {x + w} {y + h}, {x} {y + h}, {x} {y}))"


DONUT = "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (3 3, 7 3, 7 7, 3 7, 3 3))"


@pytest.mark.parametrize(
    ("a", "b", "wanted"),
    [
        (box(0, 0, 10, 10), "POINT(5 5)", {"contains", "intersects"}),
        (box(0, 0, 10, 10), "POINT(10 5)", {"intersects"}),  # a boundary point isn't contained
        (box(0, 0, 10, 10), "POINT(11 5)", set()),
        (box(0, 0, 10, 10), box(2, 2, 3, 3), {"contains", "intersects"}),
        (box(0, 0, 10, 10), box(0, 0, 3, 3), {"contains", "intersects"}),
        (box(0, 0, 10, 10), box(0, 0, 10, 10), {"contains", "within", "intersects"}),
        (box(0, 0, 10, 10), box(5, 5, 10, 10), {"overlaps", "intersects"}),
        (box(0, 0, 10, 10), box(10, 0, 5, 5), {"intersects"}),  # they touch at an edge
        (box(0, 0, 10, 10), box(2, -5, 3, 20), {"overlaps", "intersects"}),  # no vertex inside the other
        (DONUT, "POINT(5 5)", set()),
        (DONUT, box(4, 4, 1, 1), set()),
        (DONUT, box(3, 3, 4, 4), {"intersects"}),
        (box(0, 0, 10, 10), DONUT, {"contains", "intersects"}),
        (DONUT, box(0, 0, 10, 10), {"within", "intersects"}),
        (DONUT, box(1, 1, 1, 1), {"contains", "intersects"}),
        ("LINESTRING(-5 5, 15 5)", box(0, 0, 10, 10), {"crosses", "intersects"}),
        ("LINESTRING(2 5, 8 5)", box(0, 0, 10, 10), {"within", "intersects"}),
        ("LINESTRING(0 0, 10 0)", box(0, 0, 10, 10), {"intersects"}),  # along the edge
        ("LINESTRING(0 0, 10 10)", "LINESTRING(0 10, 10 0)", {"crosses", "intersects"}),
        ("LINESTRING(0 0, 10 0)", "LINESTRING(5 0, 15 0)", {"overlaps", "intersects"}),
        ("LINESTRING(0 0, 10 0)", "LINESTRING(2 0, 4 0)", {"contains", "intersects"}),
        ("LINESTRING(0 0, 10 0)", "LINESTRING(10 0, 20 0)", {"intersects"}),
        ("LINESTRING(0 0, 10 0)", "POINT(5 0)", {"contains", "intersects"}),
        ("LINESTRING(0 0, 10 0)", "POINT(0 0)", {"intersects"}),
        ("MULTIPOINT((1 1), (2 2))", "MULTIPOINT(2 2, 3 3)", {"overlaps", "intersects"}),
        ("MULTIPOINT(1 1, 20 20)", box(0, 0, 10, 10), {"crosses", "intersects"}),
        ("MULTIPOLYGON(((0 0, 4 0, 4 4, 0 4, 0 0)), ((6 0, 9 0, 9 4, 6 4, 6 0)))", box(7, 1, 1, 1), {"contains", "intersects"}),
        ("MULTIPOLYGON(((0 0, 4 0, 4 4, 0 4, 0 0)), ((6 0, 9 0, 9 4, 6 4, 6 0)))", box(3, 1, 4, 1), {"overlaps", "intersects"}),
    ],
)
def test_relations(a, b, wanted):
    assert rel(a, b) == wanted
    swapped = {"contains": "within", "within": "contains"}
    assert rel(b, a) == {swapped.get(x, x) for x in wanted}


whole = st.integers(-12, 12)
boxes = st.tuples(whole, whole, st.integers(1, 9), st.integers(1, 9))


@settings(max_examples=150, deadline=None)
@given(boxes, boxes)
def test_boxes_by_intervals(p, q):
    (x, y, w, h), (u, v, s, t) = p, q
    inside = lambda x, y, w, h, u, v, s, t: x <= u and y <= v and u + s <= x + w and v + t <= y + h
    meets = x <= u + s and u <= x + w and y <= v + t and v <= y + h
    shares = x < u + s and u < x + w and y < v + t and v < y + h
    contains, within = inside(*p, *q), inside(*q, *p)
    wanted = {"intersects"} if meets else set()
    wanted |= {"contains"} if contains else set()
    wanted |= {"within"} if within else set()
    wanted |= {"overlaps"} if shares and not contains and not within else set()
    assert rel(box(*p), box(*q)) == wanted


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(whole, whole), min_size=3, max_size=6, unique=True), boxes)
def test_laws(points, b):
    triangle = "POLYGON((" + ", ".join(f"{x} {y}" for x, y in [*points[:3], points[0]]) + "))"
    (ax, ay), (bx, by), (cx, cy) = points[:3]
    if (bx - ax) * (cy - ay) == (by - ay) * (cx - ax):
        return
    one, two = rel(triangle, box(*b)), rel(box(*b), triangle)
    assert ("contains" in one) == ("within" in two) and ("within" in one) == ("contains" in two)
    assert ("intersects" in one) == ("intersects" in two) and ("overlaps" in one) == ("overlaps" in two)
    assert not ({"contains", "within"} & one and "overlaps" in one)
    assert rel(triangle, triangle) == {"contains", "within", "intersects"}


def test_plain_shapes_by_bounds(spark):
    """Boxes and dots, for which predicates look at bounds only, against the general relation."""
    texts = [box(0, 0, 4, 4), box(1, 1, 2, 2), box(4, 0, 2, 2), box(2, 2, 6, 1), box(0, 0, 4, 2), "POINT(0 0)", "POINT(1 1)", "POINT(4 1)", "POINT(9 9)", "POLYGON((0 0, 4 0, 0 4, 0 0))"]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    made = pairs.select("a", "b", *[geo.PREDICATES[n](geo.geometry("a"), geo.geometry("b")).alias(n) for n in geo.PREDICATES]).collect()
    assert [parse(t)["plain"] for t in texts] == ["box"] * 5 + ["dot"] * 4 + [None]
    for r in made:
        assert {n for n in geo.PREDICATES if r[n]} == rel(r.a, r.b), (r.a, r.b)


def test_mirror_images_in_one_batch(spark):
    """Shapes of equal bounds, size and centroid are told apart."""
    texts = ["LINESTRING(0 0, 1 1)", "LINESTRING(0 1, 1 0)", "LINESTRING(1 1, 0 0)", "POLYGON((0 0, 2 0, 2 1, 0 2, 0 0))", "POLYGON((0 0, 2 0, 2 2, 0 1, 0 0))", "POLYGON((0 0, 0 2, 2 1, 2 0, 0 0))"]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string").coalesce(1)
    made = pairs.select("a", "b", *[geo.PREDICATES[n](geo.geometry("a"), geo.geometry("b")).alias(n) for n in geo.PREDICATES]).collect()
    for r in made:
        assert {n for n in geo.PREDICATES if r[n]} == rel(r.a, r.b), (r.a, r.b)
    assert rel(texts[0], texts[1]) == {"crosses", "intersects"} and rel(texts[0], texts[2]) == {"contains", "within", "intersects"}
    assert rel(texts[3], texts[4]) == {"overlaps", "intersects"} and rel(texts[3], texts[5]) == {"contains", "within", "intersects"}


def test_repeated_vertices_and_lines_of_one_place():
    assert rel("LINESTRING(0 0, 0 0, 4 4, 4 4)", "POINT(9 9)") == set()
    assert rel("LINESTRING(0 0, 0 0, 4 4)", "POINT(2 2)") == {"contains", "intersects"}
    assert rel("LINESTRING(3 3, 3 3)", box(0, 0, 10, 10)) == {"within", "intersects"}
    assert rel("LINESTRING(3 3, 3 3)", "LINESTRING(5 5, 5 5)") == set()
    assert rel("POLYGON((0 0, 0 0, 4 0, 4 4, 4 4, 0 0))", "POINT(3 1)") == {"contains", "intersects"}


def test_a_closed_line_has_no_ends():
    ring = "LINESTRING(0 0, 4 0, 4 4, 0 0)"
    assert rel(ring, "POINT(0 0)") == {"contains", "intersects"}
    assert rel("MULTILINESTRING((0 0, 1 1), (1 1, 2 2))", "POINT(1 1)") == {"contains", "intersects"}
    assert rel("MULTILINESTRING((0 0, 1 1), (1 1, 2 2), (1 1, 1 5))", "POINT(1 1)") == {"intersects"}  # three parts end there


diamonds = st.tuples(whole, whole, st.integers(1, 9))


@settings(max_examples=100, deadline=None)
@given(st.lists(diamonds, min_size=2, max_size=8))
def test_diamonds_are_turned_boxes(found):
    """A diamond is a box in x + y and x - y; all pairs of a list at once."""
    text = lambda x, y, r: f"POLYGON(({x + r} {y}, {x} {y + r}, {x - r} {y}, {x} {y - r}, {x + r} {y}))"
    pairs = [(p, q) for p in found for q in found]
    got = shapes.relations([parse(text(*p)) for p, _ in pairs], [parse(text(*q)) for _, q in pairs])
    for k, ((x, y, r), (u, v, s)) in enumerate(pairs):
        gap = max(abs(x + y - u - v), abs(x - y - u + v))
        wanted = {"intersects": gap <= r + s, "contains": gap <= r - s, "within": gap <= s - r, "crosses": False}
        wanted["overlaps"] = gap < r + s and gap > abs(r - s)
        assert {n: bool(v[k]) for n, v in got.items()} == wanted


def test_shapes_of_many_edges():
    """The edges are looked up, not compared one by one: 40 pairs of 20,000 edges each would be 16,000,000,000 comparisons."""
    n = 20_000
    turn = 2 * np.pi * np.arange(n) / n

    def coast(x: float) -> dict:
        r = 10 + 0.02 * np.cos(400 * turn)
        ring = np.column_stack([x + r * np.cos(turn), r * np.sin(turn)])
        return {"kind": "area", "owner": [0], "rings": [np.vstack([ring, ring[:1]])]}

    made = [coast(x) for x in (0, 0.5, 5, 19, 30)]
    got = shapes.relations([a for a in made for _ in range(5)] + made * 3, made * 5 + made[1:] + made[:1] + made[2:] + made[:2] + made)
    assert got["overlaps"][:25].reshape(5, 5).tolist() == [[i != j and abs(a - b) < 20.5 and not (abs(a - b) > 19.9) for j, b in enumerate((0, 0.5, 5, 19, 30))] for i, a in enumerate((0, 0.5, 5, 19, 30))]
    assert got["contains"][-5:].all() and got["within"][-5:].all()


def test_parsing():
    geojson = json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]], "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::25830"}}})
    found = parse(geojson)
    assert (found["kind"], found["xmax"], found["cx"], found["cy"], found["srid"]) == ("area", 4, 2, 2, 25830)
    assert parse("SRID=3857;POINT(1 2)")["srid"] == 3857
    assert parse("<http://www.opengis.net/def/crs/EPSG/0/4258> POINT(1 2)")["srid"] == 4258
    assert parse("POINT Z (1 2 3)")["cy"] == 2
    donut = parse(DONUT.replace("(3 3, 7 3, 7 7, 3 7, 3 3)", "(1 1, 2 1, 2 2, 1 2, 1 1)"))
    assert donut["cx"] == pytest.approx((100 * 5 - 1.5) / 99)
    assert parse("LINESTRING(0 0, 4 0, 4 2)")["cx"] == pytest.approx((4 * 2 + 2 * 4) / 6)
    for bad in (None, "", "POLYGON", "POINT(1", "CIRCLE(1 2)", "{}", "POINT(a b)", "POINT(nan 1)"):
        assert parse(bad) is None


def test_distances():
    """Published lines on the ellipsoid: Flinders Peak to Buninyong; a quarter of a meridian; degrees at the equator."""
    lat1, lon1 = -(37 + 57 / 60 + 3.72030 / 3600), 144 + 25 / 60 + 29.52440 / 3600
    lat2, lon2 = -(37 + 39 / 60 + 10.15610 / 3600), 143 + 55 / 60 + 35.38390 / 3600
    d = geodesy.inverse(*(np.array([x]) for x in (lat1, lon1, lat2, lon2)))[0]
    gap = abs(d - 54972.271)
    assert gap < 0.2  # the published line is on a slightly different ellipsoid
    assert geodesy.inverse(np.array([0.0]), np.array([0.0]), np.array([90.0]), np.array([0.0]))[0] == pytest.approx(geodesy.quarter_meridian(), abs=1e-3)
    assert geodesy.inverse(np.array([0.0]), np.array([0.0]), np.array([0.0]), np.array([1.0]))[0] == pytest.approx(111319.4908, abs=1e-3)
    assert geodesy.inverse(np.array([10.0]), np.array([179.5]), np.array([10.0]), np.array([-179.5]))[0] < 110_000
    assert geodesy.inverse(np.array([5.0]), np.array([5.0]), np.array([5.0]), np.array([5.0]))[0] == 0
    far = geodesy.inverse(np.array([0.0]), np.array([0.0]), np.array([0.3]), np.array([179.7]))[0]
    assert 19.8e6 < far < 20.1e6


def test_buffer_holds_what_is_near(spark):
    rng = np.random.default_rng(1)
    lat, lon = rng.uniform(-80, 80, 500), rng.uniform(-170, 170, 500)
    lat2, lon2 = lat + rng.uniform(-1, 1, 500), lon + rng.uniform(-1, 1, 500)
    near = geodesy.inverse(lat, lon, lat2, lon2) < 50_000
    rows = [(float(a), float(b)) for a, b in zip(lat, lon, strict=True)]
    point = F.struct(F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax"))
    made = spark.createDataFrame(rows, "y double, x double").select(geodesy.buffered(point, F.lit(50_000.0)).alias("b")).select("b.*").collect()
    inside = [b.xmin <= x <= b.xmax and b.ymin <= y <= b.ymax for b, x, y in zip(made, lon2, lat2, strict=True)]
    assert all(i for i, n in zip(inside, near, strict=True) if n) and near.any()


def test_boxes(spark):
    one = spark.range(1)
    bx = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("xmin", "ymin", "xmax", "ymax"), strict=True)])
    null = F.lit(None).cast("struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    r = one.select(
        geo.bbox_contains(bx(0, 0, 9, 9), bx(1, 1, 2, 2)).alias("a"), geo.bbox_contains(null, bx(1, 1, 2, 2)).alias("b"), geo.bbox_contains(bx(0, 0, 9, 9), null).alias("c"),
        geo.bbox_intersection(bx(0, 0, 2, 2), bx(2, 0, 3, 3)).alias("d"), F.size(geo.bbox_subtract(bx(0, 0, 9, 9), bx(3, 3, 4, 4))).alias("e"), geo.bbox_subtract(bx(0, 0, 2, 2), bx(5, 5, 6, 6)).alias("f"),
        geo.bbox_parse(F.lit("1, 2,3,4")).alias("g"), geo.bbox_parse(F.lit("1,2,x,4")).alias("h"), geo.bbox_wkt(bx(0, 1, 2, 3)).alias("i"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e, len(r.f)) == (True, True, False, None, 4, 1)
    assert tuple(r.g) == (1, 2, 3, 4) and r.h is None and r.i == "POLYGON((0.0 1.0, 2.0 1.0, 2.0 3.0, 0.0 3.0, 0.0 1.0))"
    boxes = spark.createDataFrame([(0.0, 0.0, 4.0, 4.0), (1.0, 1.0, 6.0, 3.0)], "xmin double, ymin double, xmax double, ymax double").select(F.struct("*").alias("b"))
    e = boxes.agg(geo.extent(F.col("b")).alias("all"), geo.common_extent(F.col("b")).alias("shared")).first()
    assert tuple(e["all"]) == (0, 0, 6, 4) and tuple(e.shared) == (1, 1, 4, 3)
