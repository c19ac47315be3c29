"""What remote sources have answered so far: a request that lies inside an earlier one isn't sent again.

A request has the source, values of columns, and perhaps a box. An earlier request holds it if it is of the same source,
asks for no value that this one doesn't, and its box (none is the whole world) holds this one's box. Answers are written,
so they stay when their session's other work is done; forget() drops them, for services whose data change.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.durable import durable
from graphloom.sources.mapping import RemoteFeatures

Box = tuple[float, float, float, float]


def holds(outer: Box | None, inner: Box | None) -> bool:
    """Whether one box holds another; none is the whole world."""
    if outer is None or inner is None:
        return outer is None
    return outer[0] <= inner[0] and outer[1] <= inner[1] and outer[2] >= inner[2] and outer[3] >= inner[3]


def written(box: Box) -> str:
    return ",".join(map(str, box))


def outermost(boxes: DataFrame, earlier: DataFrame | None = None, side: float = 1.0) -> DataFrame:
    """Of distinct boxes (column b), those that lie in no other and in no earlier one.

    A box that holds another also holds its lower left corner, so both meet in the cell of that corner: boxes go to the cells
    they cover at their own level of a grid and at all coarser levels of which there are boxes, corners to one cell at each.
    """
    size = F.greatest(F.col("b.xmax") - F.col("b.xmin"), F.col("b.ymax") - F.col("b.ymin"))
    level = F.when(size > 0, F.greatest(F.ceil(F.log2(size / side)), F.lit(0))).otherwise(0).cast("int")
    own = boxes.withColumn("level", level)
    others = own if earlier is None else own.union(earlier.withColumn("level", level))
    others = durable(others.distinct(), "boxes")
    levels = sorted(r["level"] for r in others.select("level").distinct().collect()) or [0]  # some dozens at most
    width = F.lit(side) * F.pow(F.lit(2.0), F.col("level"))
    cell = lambda c: F.floor(F.col(c) / width)
    outer = others.withColumn("cx", F.explode(F.sequence(cell("b.xmin"), cell("b.xmax")))).withColumn("cy", F.explode(F.sequence(cell("b.ymin"), cell("b.ymax"))))
    outer = outer.select("level", "cx", "cy", F.col("b").alias("o"))
    corners = boxes.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("cx", cell("b.xmin")).withColumn("cy", cell("b.ymin"))
    inside = (F.col("o.xmin") <= F.col("b.xmin")) & (F.col("o.ymin") <= F.col("b.ymin")) & (F.col("o.xmax") >= F.col("b.xmax")) & (F.col("o.ymax") >= F.col("b.ymax"))
    held = corners.join(outer, ["level", "cx", "cy"]).filter(inside & (F.col("o") != F.col("b"))).select("b").distinct()
    left = boxes.join(held, "b", "left_anti")
    return left if earlier is None else left.join(earlier, "b", "left_anti")


@dataclass
class Answers:
    """Kept answers, by source. most: none are kept beyond so many whole requests of a source; the oldest go first."""

    most: int = 64
    whole: dict[str, list[tuple[dict[str, str], Box | None, DataFrame]]] = field(default_factory=dict)
    keyed: dict[tuple, tuple[DataFrame, DataFrame]] = field(default_factory=dict)

    def forget(self) -> None:
        self.whole.clear()
        self.keyed.clear()

    def _had(self, name: str, bound: dict[str, str], box: Box | None) -> DataFrame | None:
        for had, outer, rows in self.whole.get(name, ()):
            if had.items() <= bound.items() and holds(outer, box):
                return rows
        return None

    def one(self, spark: SparkSession, name: str, remote: RemoteFeatures, push: dict[str, str], bound: dict[str, str], box: Box | None) -> DataFrame:
        """Features with the bound values (column -> value) in the box."""
        rows = self._had(name, bound, box)
        if rows is None:
            if bound or box is not None:
                ask = bound | ({"bbox": written(box)} if box is not None else {})
                made = remote.answers(spark.createDataFrame([("", ask)], "key string, ask map<string,string>"), push)
            else:
                made = remote.read(spark)
            rows = durable(made, "answers")
            kept = self.whole.setdefault(name, [])
            kept.append((bound, box, rows))
            del kept[: -self.most]
        return rows

    def each(self, name: str, remote: RemoteFeatures, push: dict[str, str], bound: dict[str, str], column: str, values: DataFrame) -> DataFrame:
        """Features with any of the values (distinct strings v; or boxes b, where column is ``bbox``) and the bound ones, and
        perhaps others that have been asked for before."""
        rows = self._had(name, bound, None)
        if rows is not None:
            return rows
        place = (name, column, tuple(sorted(bound.items())))
        asked, had = self.keyed.get(place, (None, None))
        if column == "bbox":
            new = outermost(values, asked)
            text = F.concat_ws(",", *[F.col("b")[c].cast("string") for c in ("xmin", "ymin", "xmax", "ymax")])
        else:
            new = values if asked is None else values.join(asked, "v", "left_anti")
            text = F.col("v")
        new = durable(new, "asked")
        more = [x for c, v in bound.items() for x in (F.lit(c), F.lit(v))]
        found = durable(remote.answers(new.select(text.alias("key"), F.create_map(F.lit(column), text, *more).alias("ask")), push), "answers")
        self.keyed[place] = (new if asked is None else asked.union(new), found if had is None else had.union(found))
        return self.keyed[place][1]
