"""Spatial joins against SQL: distances at the limit, and many rows of few places."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom import queries, queries_extended  # noqa: F401
from graphloom.functions import geodesy
from graphloom.functions.geometry import geometry
from graphloom.operators import spatial
from graphloom.operators.solutions import Solutions
from tests import duck


def compared(spark, folder, name: str) -> list:
    """A query's rows, which are those of its SQL over the folder."""
    with duckdb.connect() as con:
        for t in folder.iterdir():
            con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}/*.parquet')")
        wanted = con.execute(queries.SQL[name])
        names = [d[0] for d in wanted.description]
        expected = duck.rows(names, wanted.fetchall())
    df = queries.CATALOGUE[name](spark, str(folder))
    got = duck.rows(df.columns, df.collect())
    assert got == expected
    return got


@pytest.mark.parametrize("name", ["shape_q02", "shape_q07"])
def test_distance_at_the_limit(spark, tmp_path, name):
    """249,999.86 m by the closed formula, 250,000 m and more by the exact one."""
    spark.range(64).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(1, 27, "click", 2.0)], "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    places = [(1, 0, [-0.07293, -0.06092]), (2, 0, [-0.0509403199, -0.0520491786])]
    spark.createDataFrame(places, "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert len(compared(spark, tmp_path, name)) == 1


def test_places_are_compared_once(spark, tmp_path, monkeypatch):
    """1,440 customers in 720 places, and 20 suppliers in one: as many candidates as pairs of places."""
    spark.range(1440).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(20).selectExpr("720 * id AS s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    met, candidate_pairs = [], spatial.candidate_pairs
    monkeypatch.setattr(spatial, "candidate_pairs", lambda *args: met.append(candidate_pairs(*args)) or met[-1])
    assert compared(spark, tmp_path, "spatial_areas_overlap")
    assert met[0].count() < 720


def places(spark, tmp_path, vectors: list, users: list) -> None:
    """Tables of 64 boxes, vectors (hundredths of degrees first), and clicks of users."""
    spark.range(64).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(i, u, "click", float(i)) for i, u in enumerate(users)], "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(i, 0, [x / 100, y / 100]) for i, (x, y) in enumerate(vectors)], "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))


def written(monkeypatch) -> list[int]:
    """How many rows each table has that a spatial join writes."""
    found, durable = [], spatial.durable
    monkeypatch.setattr(spatial, "durable", lambda df, name: (made := durable(df, name), found.append(made.count()))[0])
    return found


def test_distances_write_no_pairs(spark, tmp_path, monkeypatch):
    """100 points within some kilometres: 4,950 pairs."""
    places(spark, tmp_path, [(20 + i / 1000, 30 + i % 7 / 100) for i in range(100)], [27])
    rows = written(monkeypatch)
    assert len(compared(spark, tmp_path, "spatial_distance")) == 4950
    assert max(rows) <= 100


def test_distances_of_repeated_places_in_cuts(spark, monkeypatch):
    """Blocks of two rows, cells cut at four pairs: as by comparing each with each, also near a pole and in a plane."""
    monkeypatch.setattr(spatial, "_ROWS", 2, raising=False)
    monkeypatch.setattr(spatial, "_PAIRS", 4, raising=False)
    texts = [f"POINT({x} {y})" for x, y in ((0, 0), (0.1, 0.1), (0.44, 0.3), (0.449, 0), (0.45, 0), (0, 0.452), (0, 0.4522), (30, 89.9), (60, 89.8), (-150, 89.95))]
    texts += [*["POINT(0 0)"] * 5, *["POINT(0.2 0)"] * 4, "SRID=25830;POINT(500000 400000)", "SRID=25830;POINT(530000 439999)", "SRID=25830;POINT(530000 440001)", "POINT(nowhere)", None]
    side = lambda a, g: Solutions.of(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], f"{a} string, {g} string"))
    found = spatial.spatial_join(side("a", "g"), side("b", "h"), "g", "h", within_metres=50_000, smallest=0.5, closed=True)
    each = side("a", "g").frame().crossJoin(side("b", "h").frame()).withColumns({"p": geometry("g"), "q": geometry("h")})
    told = geodesy.distance(F.col("p"), F.col("q"), closed=True)
    together = F.coalesce(geodesy.projected(F.col("p.srid")) == geodesy.projected(F.col("q.srid")), F.lit(False))
    wanted = sorted(tuple(r) for r in each.filter(together).select("a", "b", told.alias("d")).filter("d < 50000").collect())
    got = sorted(tuple(r) for r in found.frame().select("a", "b", "g_h_metres").collect())
    assert [r[:2] for r in got] == [r[:2] for r in wanted] and len(got) > 100
    assert all(abs(x[2] - y[2]) < 1e-6 for x, y in zip(got, wanted, strict=True))


def test_areas_are_keys_of_distances(spark, tmp_path, monkeypatch):
    """Points near a patch, some of them in its area: no pair is filtered by a predicate after the join."""
    places(spark, tmp_path, [(22 + i / 10, i % 5) for i in range(-20, 20)], [27])
    monkeypatch.setattr(spatial, "spatial_filter", lambda *args, **more: pytest.fail("filtered pair by pair"))
    assert len(compared(spark, tmp_path, "shape_q03")) > 100


def test_observations_come_last(spark, tmp_path, monkeypatch):
    """200 clicks in an area of 12 places: what spatial joins write doesn't grow with the clicks."""
    places(spark, tmp_path, [(-9 + i / 4, -9 + i / 4) for i in range(12)], [27] * 200 + [70])
    rows = written(monkeypatch)
    assert len(compared(spark, tmp_path, "shape_q07")) > 1000
    assert max(rows) <= 100
