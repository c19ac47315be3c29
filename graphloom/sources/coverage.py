"""Coverages: a request URL for each driving box, as subject of triples; pixels are never read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.geometry import bbox_wkt
from graphloom.functions.scalars import is_coverage

#: Degrees by which the box of a point is widened on each side.
POINT_SLACK = 0.01


def widened(box: Column, slack: float = POINT_SLACK) -> Column:
    """Boxes without extent in a direction get one."""
    flat_x, flat_y = box["xmin"] == box["xmax"], box["ymin"] == box["ymax"]
    pad = lambda c, by, flat: F.when(flat, box[c] + by).otherwise(box[c]).alias(c)
    return F.struct(pad("xmin", -slack, flat_x), pad("ymin", -slack, flat_y), pad("xmax", slack, flat_x), pad("ymax", slack, flat_y))


def coverages(boxes: DataFrame, url: str, box: str = "box", parameters: dict[str, str] | None = None) -> DataFrame:
    """boxes with ``coverage`` (the request's URL, the box as latitude and longitude) and ``coverage_wkt`` (x, y order).

    A coverage has no rows of its own: without a box there is nothing to ask for, so a null box is an error.
    """
    b = widened(F.col(box))
    needed = F.when(F.col(box).isNull(), F.raise_error(F.lit("a coverage needs a box"))).otherwise(F.lit(""))
    pairs = "".join(f"&{k}={v}" for k, v in (parameters or {}).items())
    at = F.concat_ws(",", *[b[c].cast("string") for c in ("ymin", "xmin", "ymax", "xmax")])
    full = F.concat(needed.cast("string"), F.lit(url + ("&" if "?" in url else "?")), F.lit("BBOX="), at, F.lit(pairs))
    return boxes.withColumns({"coverage": full, "coverage_wkt": bbox_wkt(b)})


def raster_corners(url: Column, box: Column) -> Column:
    """Top left, top right, bottom right and bottom left of a coverage's box; null for other URLs."""
    corner = lambda x, y: F.array(box[x], box[y])
    return F.when(is_coverage(url) & box.isNotNull(), F.array(corner("xmin", "ymax"), corner("xmax", "ymax"), corner("xmax", "ymin"), corner("xmin", "ymin")))
