"""Spatial joins on a grid of many levels.

A geometry belongs to the level at which its envelope covers four cells at most. A pair meets at the coarser of its two
levels: each side emits its cells at its own level and at the coarser ones that the other side has. One cell decides for
each pair (the one with the lower left corner of what the envelopes share), so nothing has to be deduplicated, and a huge
polygon costs four rows, not a row for each small cell that it covers. The join is an equality of cells; envelopes and
then the exact predicate refine it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.geodesy import buffered, chord2, chords, distance, half_of, lambert_of, projected, sphere
from graphloom.functions.geometry import PREDICATES, envelope, geometry
from graphloom.operators.durable import durable
from graphloom.operators.solutions import Solutions, TermType, Var


#: What a predicate is with its sides exchanged; the others are the same.
TURNED = {"contains": "within", "within": "contains"}
#: What a closed formula's distances may be off by, as a part of them: candidates are looked for so much farther.
CLOSED = 1e-5
#: Rows of one place that stand together; pairs of rows that a task looks at, if cells are even; and the most tasks.
_ROWS, _PAIRS, _TASKS = 256, 1 << 19, 1 << 14


def _leveled(df: DataFrame, box: str, smallest: float) -> DataFrame:
    size = F.greatest(F.col(f"{box}.xmax") - F.col(f"{box}.xmin"), F.col(f"{box}.ymax") - F.col(f"{box}.ymin"))
    return df.withColumn(f"{box}_level", F.greatest(F.ceil(F.log2(size / smallest)), F.lit(0)).cast("int")).na.fill({f"{box}_level": 0})


def _cells(df: DataFrame, box: str, levels: list[int], smallest: float) -> DataFrame:
    """A row for each level from a geometry's own on, and cell there."""
    at = F.explode(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x >= F.col(f"{box}_level")))
    df = df.withColumn("level", at)
    cell = lambda c: F.floor(F.col(f"{box}.{c}") / (F.lit(smallest) * F.pow(F.lit(2.0), F.col("level"))))
    df = df.withColumn("cell_x", F.explode(F.sequence(cell("xmin"), cell("xmax"))))
    return df.withColumn("cell_y", F.explode(F.sequence(cell("ymin"), cell("ymax"))))


def candidate_pairs(left: DataFrame, right: DataFrame, smallest: float) -> DataFrame:
    """Pairs whose envelopes (columns a and b) meet, each once. The levels that occur, some dozens at most, come to the driver.

    Both sides are written first: they are read for their levels and for the join, but geometries are parsed once.
    """
    left = durable(_leveled(left.filter("a IS NOT NULL"), "a", smallest), "spatial")
    right = durable(_leveled(right.filter("b IS NOT NULL"), "b", smallest), "spatial")
    found = left.select(F.col("a_level").alias("x")).distinct().union(right.select(F.col("b_level").alias("x")).distinct()).distinct()
    levels = sorted(r["x"] for r in found.collect()) or [0]
    pairs = _cells(left, "a", levels, smallest).join(_cells(right, "b", levels, smallest), ["level", "cell_x", "cell_y"])
    side = F.lit(smallest) * F.pow(F.lit(2.0), F.col("level"))
    own = (F.col("level") == F.greatest("a_level", "b_level")) & (F.floor(F.greatest("a.xmin", "b.xmin") / side) == F.col("cell_x")) & (F.floor(F.greatest("a.ymin", "b.ymin") / side) == F.col("cell_y"))
    meet = (F.col("a.xmin") <= F.col("b.xmax")) & (F.col("b.xmin") <= F.col("a.xmax")) & (F.col("a.ymin") <= F.col("b.ymax")) & (F.col("b.ymin") <= F.col("a.ymax"))
    return pairs.filter(own & meet).drop("level", "cell_x", "cell_y", "a_level", "b_level")


@dataclass(frozen=True)
class Relation:
    """A spatial constraint: predicate(?a, ?b), or ?a with a constant geometry's text, or centroids less than metres apart
    (closed: by Lambert's closed formula, which SQL can tell in the same digits)."""

    a: str
    b: str | None = None
    predicate: str | None = None
    metres: float | None = None
    constant: str | None = None
    closed: bool = False

    @property
    def vars(self) -> set[str]:
        return {self.a, self.b} - {None}


def spatial_join(left: Solutions, right: Solutions, a: str, b: str, predicate: str | None = None, within_metres: float | None = None, smallest: float = 0.01, closed: bool = False) -> Solutions:
    """Compatible pairs of solutions whose geometries ?a (left) and ?b (right) fulfil ``predicate(a, b)`` (contains, within,
    intersects, overlaps, crosses) and, if given, whose centroids lie less than within_metres apart (bound to ``?a_b_metres``).

    Variables that the sides share must always be bound; they are further keys of the join of cells. smallest: the side
    of a cell at the finest level, in the geometries' units.

    Places are joined, not rows: each distinct geometry is parsed once, each pair of them compared once, however many rows
    of either side have it. Rows come back by equi-joins.
    """
    shared = [n for n in left.vars if n in right.vars]
    if any(s.vars[n].maybe for s in (left, right) for n in shared):
        raise ValueError("variables that the sides of a spatial join share are always bound")
    if closed and within_metres is not None and predicate is None:
        return _near(left, right, a, b, within_metres, smallest)
    names = [*left.vars, *(n for n in right.vars if n not in left.vars)]
    right = right._renamed("~spatial") if shared else right
    equal = left._pairs(right, shared)

    def side(s: Solutions, name: str, box: str, keys: Sequence[Column]) -> tuple[DataFrame, DataFrame, list[str]]:
        """The solutions with their place (a geometry's text and the shared variables' keys), and the distinct places, parsed."""
        place = {f"{box}_text": s.term(name).cast("string")} | {f"{box}_key{i}": k for i, k in enumerate(keys)}
        rows = durable(s.df.withColumns(place).filter(F.col(f"{box}_text").isNotNull()), "spatial")
        g = f"{box}_geometry"
        df = rows.select(*place).distinct().withColumn(g, geometry(F.col(f"{box}_text")))
        if within_metres is None:
            return rows, df.withColumn(box, envelope(F.col(g))), list(place)
        centre = F.when(F.col(g)["kind"].isNotNull(), F.struct(*[F.col(g)[c].alias(n) for c, n in (("cx", "xmin"), ("cy", "ymin"), ("cx", "xmax"), ("cy", "ymax"))]))
        return rows, df.withColumn(box, F.when(centre.isNotNull(), buffered(centre, F.lit(within_metres * (1 + CLOSED if closed else 1.0)), F.col(g)["srid"])) if box == "a" else centre), list(place)

    ones, a_places, a_place = side(left, a, "a", [x for x, _ in equal or []])
    twos, b_places, b_place = side(right, b, "b", [y for _, y in equal or []])
    pairs = candidate_pairs(a_places, b_places, smallest)
    for x, y in zip(a_place[1:], b_place[1:], strict=True):
        pairs = pairs.filter(F.col(x) == F.col(y))  # an inner join's filter: these become keys of it
    pairs = pairs.filter(F.lit(False)) if equal is None else pairs
    found = left.vars | {n: v for n, v in right.vars.items() if n not in left.vars}
    told = []
    if within_metres is not None:
        metres = f"{a}_{b}_metres"
        pairs = pairs.withColumn(metres, distance(F.col("a_geometry"), F.col("b_geometry"), closed)).filter(F.col(metres) < within_metres)
        found |= {metres: Var(TermType("literal", "http://www.w3.org/2001/XMLSchema#double"), (metres,), (pairs.schema[metres].dataType,))}
        names.append(metres)
        told.append(metres)
    if predicate:
        pairs = pairs.filter(PREDICATES[predicate]("a_geometry", "b_geometry"))
    pairs = durable(pairs.select(*a_place, *b_place, *told), "spatial-pairs")
    made = Solutions(ones.join(pairs, a_place).join(twos, b_place).drop(*a_place, *b_place), found)
    return made._tidy(names, set()) if shared else made


# ---- distances by the closed formula: native from end to end, rows travel with their places


def _blocks(s: Solutions, name: str, box: str, keys: Sequence[Column]) -> DataFrame:
    """The places of a variable's geometries (with keys), each with its rows in blocks of some _ROWS, however many it has."""
    columns = [c for v in s.vars.values() for c in v.columns]
    place = {"text": s.term(name).cast("string")} | {f"key{i}": k for i, k in enumerate(keys)}
    known = reduce(Column.__and__, [c.isNotNull() for c in place.values()])
    own = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    rows = durable(s.df.filter(known).select(*[c.alias(n) for n, c in place.items()], own.alias("own"), F.monotonically_increasing_id().alias("row")), "spatial")
    many = rows.groupBy(*place).count().filter(F.col("count") > _ROWS).select(*place, F.ceil(F.col("count") / _ROWS).alias("blocks"))
    dealt = rows.join(many, list(place), "left").withColumn("block", F.pmod(F.xxhash64("row"), F.coalesce("blocks", F.lit(1))))
    df = dealt.groupBy(*place, "block").agg(F.collect_list("own").alias("rows")).withColumn("g", geometry(F.col("text"))).filter("g.kind IS NOT NULL")
    at = [F.col("g")[c].alias(f"{box}_{c}") for c in ("cx", "cy", "srid")]
    return df.select(*[F.col(f"key{i}") for i in range(len(keys))], F.col("rows").alias(f"{box}_rows"), *at).withColumns(sphere(f"{box}_"))


def _cut(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides dealt for a join on keys, and the keys of that: by the pairs of rows that meet there, not by bytes.

    A key at which more than _PAIRS meet is cut: the left rows are spread over its cuts, the right ones stand in each.
    """
    ones, twos = (df.groupBy(*keys).agg(F.sum(F.size(f"{box}_rows")).cast("double").alias(f"{box}_n")) for df, box in ((left, "a"), (right, "b")))
    work = durable(ones.join(twos, list(keys)).select(*keys, (F.col("a_n") * F.col("b_n")).alias("pairs")), "spatial")
    parts = min(max(int((work.agg(F.sum("pairs")).first()[0] or 0) // _PAIRS) + 1, 1), _TASKS)
    heavy = work.filter(F.col("pairs") > _PAIRS).select(*keys, F.least(F.ceil(F.col("pairs") / _PAIRS), F.lit(_TASKS)).cast("int").alias("cuts"))
    left = left.join(heavy, list(keys), "left").withColumn("cut", F.pmod(F.xxhash64("block"), F.coalesce("cuts", F.lit(1))).cast("int"))
    right = right.join(heavy, list(keys), "left").withColumn("cut", F.explode(F.sequence(F.lit(0), F.coalesce("cuts", F.lit(1)) - 1)))
    on = [*keys, "cut"]
    return left.drop("cuts", "block").repartition(parts, *on), right.drop("cuts").repartition(parts, *on), on


def _near(left: Solutions, right: Solutions, a: str, b: str, metres: float, smallest: float) -> Solutions:
    """spatial_join() for a distance by the closed formula.

    A cell's side is a quarter to a half of a search box's at least, so that few more pairs meet than are near. A pair is
    judged by its chord on the formula's sphere; only at the limit's edge the formula itself decides. Rows stand beside
    their places, in blocks: no pair is written or shuffled.
    """
    shared = [n for n in left.vars if n in right.vars]
    names = [*left.vars, *(n for n in right.vars if n not in left.vars)]
    other = right._renamed("~spatial") if shared else right
    equal = left._pairs(other, shared)
    keys = [f"key{i}" for i in range(len(equal or []))]
    ones = _blocks(left, a, "a", [x for x, _ in equal or []])
    twos = _blocks(other, b, "b", [y for _, y in equal or []])
    box = buffered(F.struct(*[F.col(f"a_{c}").alias(n) for c, n in (("cx", "xmin"), ("cy", "ymin"), ("cx", "xmax"), ("cy", "ymax"))]), F.lit(metres * (1 + CLOSED)), F.col("a_srid"))
    size = F.greatest(F.col("box.xmax") - F.col("box.xmin"), F.col("box.ymax") - F.col("box.ymin"))
    ones = ones.withColumn("box", box).withColumn("level", F.coalesce(F.greatest(F.ceil(F.log2(size / smallest)) - 2, F.lit(0)), F.lit(0)).cast("int"))
    ones, twos = durable(ones.withColumn("block", F.monotonically_increasing_id()), "spatial"), durable(twos, "spatial")
    levels = sorted(r["level"] for r in ones.select("level").distinct().collect()) or [0]
    cell = lambda c: F.floor(c / (F.lit(smallest) * F.pow(F.lit(2.0), F.col("level"))))
    for c in "xy":
        ones = ones.withColumn(f"cell_{c}", F.explode(F.sequence(cell(F.col(f"box.{c}min")), cell(F.col(f"box.{c}max")))))
    twos = twos.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]))).withColumns({f"cell_{c}": cell(F.col(f"b_c{c}")) for c in "xy"})
    ones, twos, on = _cut(ones.drop("box"), twos, [*keys, "level", "cell_x", "cell_y"])

    low, high = chords(metres)
    flat = projected(F.col("a_srid")) & (F.col("a_srid") == F.col("b_srid"))
    flat = F.coalesce(flat, F.lit(False))
    plane = F.hypot(F.col("a_cx") - F.col("b_cx"), F.col("a_cy") - F.col("b_cy"))
    chord = chord2("a_", "b_")
    pairs = ones.join(twos, on).filter(F.when(flat, plane < metres).otherwise(chord < high))
    pairs = pairs.filter(F.lit(False)) if equal is None else pairs
    # a generator, so that no filter below repeats what is inside
    half = F.explode(F.array(half_of("a_", "b_")))
    told = F.when(flat, plane).otherwise(lambert_of(F.col("half"), F.col("a_phi"), F.col("b_phi")))
    pairs = pairs.withColumn("half", half).withColumn("metres", told).filter(flat | (chord < low) | (F.col("metres") < metres))
    made = pairs.select("metres", F.explode("a_rows").alias("one"), "b_rows").select("metres", "one", F.explode("b_rows").alias("two"))
    back = [F.col(row)[f"c{i}"].alias(c) for row, s in (("one", left), ("two", other)) for i, c in enumerate(c for v in s.vars.values() for c in v.columns)]
    name = f"{a}_{b}_metres"
    found = left.vars | {n: v for n, v in other.vars.items() if n not in left.vars}
    found |= {name: Var(TermType("literal", "http://www.w3.org/2001/XMLSchema#double"), (name,), (T.DoubleType(),))}
    joined = Solutions(made.select(*back, F.col("metres").alias(name)), found)
    return joined._tidy([*names, name], set()) if shared else joined


def spatial_filter(solutions: Solutions, predicate: str | None, a: str, b: str | None = None, constant: str | None = None, within_metres: float | None = None, closed: bool = False) -> Solutions:
    """Solutions whose geometry ?a fulfils the predicate with ?b or with a constant geometry's text and, if given, whose
    centroid lies less than within_metres from that one's."""
    one = geometry(solutions.term(a).cast("string"))
    two = geometry(F.lit(constant)) if constant is not None else geometry(solutions.term(b).cast("string"))
    df = solutions.df.withColumns({"a.g": one, "b.g": two})
    if within_metres is not None:
        df = df.filter(distance(F.col("`a.g`"), F.col("`b.g`"), closed) < within_metres)
    if predicate:
        df = df.filter(PREDICATES[predicate](F.col("`a.g`"), F.col("`b.g`")))
    return Solutions(df.drop("a.g", "b.g"), solutions.vars)


def related(left: Solutions, right: Solutions, relations: Sequence[Relation], smallest: float) -> Solutions:
    """Both sides joined by the closest of the relations between them. Of the others, one by a predicate with another of left's
    variables is a key of that join: which of that variable's places the right side's lie in is told first, place by place.
    The rest filter the pairs."""
    first, *rest = sorted(relations, key=lambda r: (r.metres is None, r.metres or 0.0))
    ends = lambda r: (r.a, r.b) if r.a in left.vars else (r.b, r.a)
    key = next((r for r in rest if r.metres is None and ends(r)[0] != ends(first)[0] and not left.vars[ends(r)[0]].maybe), None) if first.metres is not None else None
    turned = first.a not in left.vars
    if key is not None:
        rest.remove(key)
        left = replace(left, df=durable(left.df, "spatial"))
        right = related(left.select(ends(key)[0]).distinct(), right, [key], smallest)
    one, two, predicate = (first.b, first.a, TURNED.get(first.predicate, first.predicate)) if turned else (first.a, first.b, first.predicate)
    found = spatial_join(left, right, one, two, predicate, first.metres, smallest, first.closed)
    found = found.select(*[n for n in found.vars if n in left.vars or n in right.vars])
    for r in rest:
        found = spatial_filter(found, r.predicate, r.a, r.b, within_metres=r.metres, closed=r.closed)
    return found


def in_box(solutions: Solutions, x: str, y: str, box: tuple[float, float, float, float]) -> Solutions:
    """A box constraint on point coordinates that a source holds as numbers: it reaches the scan."""
    bounds: list[Column] = [F.col(x) >= box[0], F.col(y) >= box[1], F.col(x) <= box[2], F.col(y) <= box[3]]
    return solutions.filter(reduce(Column.__and__, bounds))
