"""Geometries: parsing once for each column, envelopes as native columns, exact predicates in Arrow batches.

A parsed geometry is a struct: kind (point, line or area; collections of one dimension), its parts as lists of
coordinates, its envelope, its centroid and the spatial reference. plain says that the envelope is all there is to it: a
single point, or a box with sides along the axes. What has no valid text is null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.shapes import relations

#: rings: for areas, closed; a ring's first number is which polygon it belongs to. flat: x, y, x, y ...
_BOUNDS = ("xmin", "ymin", "xmax", "ymax", "cx", "cy")
GEOMETRY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("owner", T.ArrayType(T.IntegerType())), T.StructField("rings", T.ArrayType(T.ArrayType(T.DoubleType()))), *(T.StructField(c, T.DoubleType()) for c in _BOUNDS), T.StructField("srid", T.IntegerType()), T.StructField("plain", T.StringType())])
KINDS = ("point", "line", "area")
_TOKEN = re.compile(r"\(|\)|,|[-+0-9.eE]+")


def _nested(tokens: Iterator[str]) -> list:
    """Coordinates of a WKT body as nested lists, as GeoJSON has them."""
    out: list = []
    point: list[float] = []
    for t in tokens:
        if t == "(":
            out.append(_nested(tokens))
        elif t in "),":
            if point:
                out.append(point)
                point = []
            if t == ")":
                return out
        else:
            point.append(float(t))
    raise ValueError("unbalanced")


def _from_text(text: str) -> tuple[str, list, int]:
    """Kind, coordinates and reference of WKT, EWKT, WKT with a leading reference IRI, or GeoJSON."""
    text, srid = text.strip(), 4326
    if m := re.match(r"(?i)SRID=(\d+);\s*", text):
        srid, text = int(m[1]), text[m.end() :]
    if m := re.match(r"<([^>]*)>\s*", text):
        srid, text = int(re.search(r"(\d+)$", m[1])[1]) if re.search(r"EPSG.*?(\d+)$", m[1]) else srid, text[m.end() :]
    if text.startswith("{"):
        found = json.loads(text)
        if named := ((found.get("crs") or {}).get("properties") or {}).get("name"):
            srid = int(m[1]) if (m := re.search(r"(\d+)$", str(named))) else srid
        return found["type"].upper(), found["coordinates"], srid
    name, _, rest = text.partition("(")
    kind = name.strip().upper().split()[0]
    body = _nested(iter(_TOKEN.findall(rest)))
    return kind, body[0] if kind == "POINT" else [p[0] if p and isinstance(p[0], list) else p for p in body] if kind == "MULTIPOINT" else body, srid


def parse(text: str | None) -> dict | None:
    try:
        kind, coordinates, srid = _from_text(text)
        polygons: list[list] = {"POINT": [[[coordinates]]], "MULTIPOINT": [[[p]] for p in coordinates], "LINESTRING": [[coordinates]], "MULTILINESTRING": [[c] for c in coordinates], "POLYGON": [coordinates], "MULTIPOLYGON": coordinates}[kind]
        shape = KINDS[{"POINT": 0, "MULTIPOINT": 0, "LINESTRING": 1, "MULTILINESTRING": 1}.get(kind, 2)]
        owner, rings = [], []
        for i, polygon in enumerate(polygons):
            for ring in polygon:
                points = np.array([p[:2] for p in ring], float).reshape(-1, 2)
                if shape == "area" and (points[0] != points[-1]).any():
                    points = np.vstack([points, points[:1]])
                owner.append(i)
                rings.append(points)
        whole = np.vstack(rings)
        if not np.isfinite(whole).all():
            return None
        cx, cy = _centroid(shape, owner, rings)
        low, high = whole.min(axis=0), whole.max(axis=0)
        return {"kind": shape, "owner": owner, "rings": [r.ravel().tolist() for r in rings], "xmin": low[0], "ymin": low[1], "xmax": high[0], "ymax": high[1], "cx": cx, "cy": cy, "srid": srid, "plain": _plain(shape, rings, low, high)}
    except (ValueError, KeyError, TypeError, IndexError, AttributeError, StopIteration):
        return None


def _plain(kind: str, rings: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> str | None:
    if len(rings) > 1:
        return None
    if kind == "point":
        return "dot"
    r = rings[0]
    if kind == "area" and len(r) == 5 and (low < high).all():
        corners = ((r == low) | (r == high)).all() and len({tuple(p) for p in r[:4].tolist()}) == 4
        turns = ((r[1:] == r[:-1]).sum(axis=1) == 1).all()  # each side changes one coordinate
        return "box" if corners and turns else None
    return None


def _centroid(kind: str, owner: list[int], rings: list[np.ndarray]) -> tuple[float, float]:
    """Mean of points; of lines by length, of areas by area (holes count against)."""
    if kind == "area":
        base, total, moment = rings[0][0], 0.0, np.zeros(2)
        for i, ring in enumerate(rings):
            r = ring - base
            cross = r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]
            sign = np.sign(cross.sum()) or 1.0
            hole = i > 0 and owner[i - 1] == owner[i]
            weight = -sign if hole else sign
            total += weight * cross.sum() / 2
            moment += weight * ((r[:-1] + r[1:]) * cross[:, None]).sum(axis=0) / 6
        if total:
            return tuple((moment / total + base).tolist())
        kind = "line"
    if kind == "line":
        parts = [((r[:-1] + r[1:]) / 2, np.hypot(*(r[1:] - r[:-1]).T)) for r in rings]
        weight = np.concatenate([w for _, w in parts])
        if weight.sum():
            return tuple(((np.vstack([m for m, _ in parts]) * weight[:, None]).sum(axis=0) / weight.sum()).tolist())
    return tuple(np.vstack(rings).mean(axis=0).tolist())


#: A point's text as most sources write it.
_POINT = re.compile(r"(?i)\s*POINT\s*\(\s*([-+]?[0-9]+(?:\.[0-9]*)?(?:E[-+]?[0-9]+)?)\s+([-+]?[0-9]+(?:\.[0-9]*)?(?:E[-+]?[0-9]+)?)\s*\)\s*")


def _dot(x: float, y: float) -> dict:
    return {"kind": "point", "owner": [0], "rings": [[x, y]], "xmin": x, "ymin": y, "xmax": x, "ymax": y, "cx": x, "cy": y, "srid": 4326, "plain": "dot"}


@F.pandas_udf(GEOMETRY)
def geometry(text: pd.Series) -> pd.DataFrame:
    """Parses WKT, EWKT or GeoJSON; equal texts of a batch are parsed once, plain points by one match."""
    seen: dict = {}
    rows = []
    for t in text:
        if t not in seen:
            point = _POINT.fullmatch(t) if t else None
            seen[t] = _dot(float(point[1]), float(point[2])) if point and len(t) < 200 else parse(t)
        rows.append(seen[t])
    empty = dict.fromkeys(GEOMETRY.names)
    frame = pd.DataFrame([r or empty for r in rows], columns=list(empty))
    frame["srid"] = frame["srid"].astype("Int32")
    frame["plain"] = frame["plain"].astype(object)
    return frame


# ---- exact predicates


def _plainly(name: str, one: pd.DataFrame, two: pd.DataFrame) -> np.ndarray:
    """The predicate for dots and boxes, by their bounds. Two dots are one or none."""
    a, b = ({c: f[c].to_numpy(float) for c in ("xmin", "ymin", "xmax", "ymax")} for f in (one, two))
    dot_a, dot_b = one["plain"].to_numpy() == "dot", two["plain"].to_numpy() == "dot"
    meets = (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])
    shares = (a["xmin"] < b["xmax"]) & (b["xmin"] < a["xmax"]) & (a["ymin"] < b["ymax"]) & (b["ymin"] < a["ymax"])

    def holds(p: dict, q: dict, dot_p: np.ndarray, dot_q: np.ndarray) -> np.ndarray:
        closed = (p["xmin"] <= q["xmin"]) & (p["ymin"] <= q["ymin"]) & (p["xmax"] >= q["xmax"]) & (p["ymax"] >= q["ymax"])
        return np.where(dot_p, dot_q & meets, np.where(dot_q, shares, closed))

    contains, within = holds(a, b, dot_a, dot_b), holds(b, a, dot_b, dot_a)
    return {"contains": contains, "within": within, "intersects": meets, "overlaps": shares & ~contains & ~within & ~dot_a & ~dot_b, "crosses": np.zeros(len(one), bool)}[name]


def _lines_and_boxes(name: str, lines: pd.DataFrame, boxes: pd.DataFrame, line_first: bool) -> np.ndarray:
    """The predicate for lines and boxes, all pairs of a batch at once: each segment is clipped by its pair's box."""
    rings = [np.asarray(r, float).reshape(-1, 2) for parts in lines["rings"] for r in parts]
    of = np.repeat(np.arange(len(lines)), [len(parts) for parts in lines["rings"]])
    segments = np.array([len(r) - 1 for r in rings])
    pair = np.repeat(of, segments)
    a, b = np.vstack([r[:-1] for r in rings]), np.vstack([r[1:] for r in rings])
    low, high = (boxes[[f"x{m}", f"y{m}"]].to_numpy(float)[pair] for m in ("min", "max"))
    d = b - a
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.stack([(low - a) / d, (high - a) / d])
    flat = d == 0  # runs along an axis: in the box's range there or never
    enter = np.where(flat, -np.inf, t.min(axis=0)).max(axis=1).clip(min=0)
    leave = np.where(flat, np.inf, t.max(axis=0)).min(axis=1).clip(max=1)
    closed = (enter <= leave) & (~flat | (low <= a) & (a <= high)).all(axis=1)
    middle = a + d * ((enter + leave) / 2)[:, None]
    opened = closed & ((enter < leave) | flat.all(axis=1)) & ((low < middle) & (middle < high)).all(axis=1)
    outside = ((a < low) | (a > high) | (b < low) | (b > high)).any(axis=1)
    meets, inner, out = (np.bincount(pair, x, len(lines)) > 0 for x in (closed, opened, outside))
    held = inner & ~out
    none = np.zeros(len(lines), bool)
    return {"contains": none if line_first else held, "within": held if line_first else none, "intersects": meets, "overlaps": none, "crosses": inner & out}[name]


def _predicate(name: str):
    @F.pandas_udf(T.BooleanType())
    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.Series:
        known = one["kind"].notna().to_numpy() & two["kind"].notna().to_numpy()
        out = np.full(len(one), None, object)
        out[known] = False
        meet = known & (one["xmin"].to_numpy(float) <= two["xmax"].to_numpy(float)) & (two["xmin"].to_numpy(float) <= one["xmax"].to_numpy(float))
        meet &= (one["ymin"].to_numpy(float) <= two["ymax"].to_numpy(float)) & (two["ymin"].to_numpy(float) <= one["ymax"].to_numpy(float))
        plain = meet & one["plain"].notna().to_numpy() & two["plain"].notna().to_numpy()
        out[plain] = _plainly(name, one[plain], two[plain])
        box_one, box_two = (f["plain"].to_numpy() == "box" for f in (one, two))
        line_one, line_two = (f["kind"].to_numpy() == "line" for f in (one, two))
        for these, lines, boxes, first in ((meet & line_one & box_two, one, two, True), (meet & box_one & line_two, two, one, False)):
            if these.any():
                out[these] = _lines_and_boxes(name, lines[these], boxes[these], first)
                plain |= these
        at = np.flatnonzero(meet & ~plain)
        sides = (f.iloc[at][["kind", "owner", "rings"]].to_dict("records") for f in (one, two))
        out[at] = relations(*sides)[name]
        return pd.Series(out, dtype="object").astype("boolean")

    return run


PREDICATES = {name: _predicate(name) for name in ("contains", "within", "intersects", "overlaps", "crosses")}


# ---- envelopes


def envelope(g: Column) -> Column:
    return F.when(g["kind"].isNotNull(), F.struct(*[g[c].alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]))


def bbox_contains(outer: Column, inner: Column) -> Column:
    """No outer box bounds nothing; no inner box lies in none but that."""
    inside = (outer["xmin"] <= inner["xmin"]) & (outer["ymin"] <= inner["ymin"]) & (outer["xmax"] >= inner["xmax"]) & (outer["ymax"] >= inner["ymax"])
    return F.when(outer.isNull(), True).when(inner.isNull(), False).otherwise(inside)


def bbox_intersection(a: Column, b: Column) -> Column:
    """Null where they share no area."""
    box = F.struct(F.greatest(a["xmin"], b["xmin"]).alias("xmin"), F.greatest(a["ymin"], b["ymin"]).alias("ymin"), F.least(a["xmax"], b["xmax"]).alias("xmax"), F.least(a["ymax"], b["ymax"]).alias("ymax"))
    return F.when((box["xmin"] < box["xmax"]) & (box["ymin"] < box["ymax"]), box)


def bbox_subtract(a: Column, b: Column) -> Column:
    """What is left of a: up to four boxes."""
    c = bbox_intersection(a, b)
    box = lambda *v: F.struct(*[x.alias(n) for x, n in zip(v, ("xmin", "ymin", "xmax", "ymax"), strict=True)])
    parts = F.array(box(a["xmin"], a["ymin"], a["xmax"], c["ymin"]), box(a["xmin"], c["ymax"], a["xmax"], a["ymax"]), box(a["xmin"], c["ymin"], c["xmin"], c["ymax"]), box(c["xmax"], c["ymin"], a["xmax"], c["ymax"]))
    return F.when(c.isNull(), F.array(a)).otherwise(F.filter(parts, lambda p: (p["xmin"] < p["xmax"]) & (p["ymin"] < p["ymax"])))


def bbox_wkt(b: Column) -> Column:
    """The box as a closed ring."""
    t = {n: b[n].cast("string") for n in ("xmin", "ymin", "xmax", "ymax")}
    corners = (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin"))
    return F.when(b.isNotNull(), F.concat(F.lit("POLYGON(("), F.array_join(F.array(*[F.concat_ws(" ", t[x], t[y]) for x, y in corners]), ", "), F.lit("))")))


def bbox_parse(text: Column) -> Column:
    """From ``minx,miny,maxx,maxy``; null for anything else."""
    n = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))
    box = F.struct(*[F.get(n, F.lit(i)).alias(c) for i, c in enumerate(("xmin", "ymin", "xmax", "ymax"))])
    return F.when((F.size(n) == 4) & F.forall(n, Column.isNotNull), box)


def extent(box: Column) -> Column:
    """Aggregate: the box around all; null for none."""
    return F.struct(F.min(box["xmin"]).alias("xmin"), F.min(box["ymin"]).alias("ymin"), F.max(box["xmax"]).alias("xmax"), F.max(box["ymax"]).alias("ymax"))


def common_extent(box: Column) -> Column:
    """Aggregate: the box that all share; null where there is none."""
    b = [F.max(box["xmin"]), F.max(box["ymin"]), F.min(box["xmax"]), F.min(box["ymax"])]
    return F.when((b[0] <= b[2]) & (b[1] <= b[3]), F.struct(*[x.alias(n) for x, n in zip(b, ("xmin", "ymin", "xmax", "ymax"), strict=True)]))
