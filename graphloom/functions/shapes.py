"""Exact relations between points, lines and areas, for many pairs at once.

A shape's edges are indexed by strips across its longer side, sorted by strip, so a point or an edge of another shape meets
only the edges of the strips it touches. All shapes of a batch share one index, and every step below runs over all pairs of
the batch in numpy: the edges of one shape in the window that the other one covers, where they are cut, and where the
pieces between the cuts, the vertices and the ends lie. No step compares all edges of one shape with all of another.

A line's boundary is the ends that an odd number of its parts have. Distances up to ``scale`` count as none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

POINT, LINE, AREA = range(3)
KINDS = {"point": POINT, "line": LINE, "area": AREA}
#: Candidates of one step at most, about; larger steps are done in parts.
STEP = 1 << 19
#: Entries in the strips for each edge, about.
SPREAD = 3
NAMES = ("contains", "within", "intersects", "overlaps", "crosses")
#: Places of a point, as where() tells them.
OUTSIDE, BOUNDARY, INSIDE = range(3)


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges low[i]..high[i] - 1, and the i of each."""
    n = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + low[owner], owner


def _inner_points(rings: list[np.ndarray], owner: np.ndarray) -> np.ndarray:
    """A point inside each polygon of an area: the middle of the widest stretch of a scan line between two heights."""
    out = []
    for i in np.unique(owner):
        own = [r for r, o in zip(rings, owner, strict=True) if o == i]
        heights = np.unique(np.concatenate([r[:, 1] for r in own]))
        if len(heights) < 2:
            continue
        k = int(np.argmax(np.diff(heights)))
        y = (heights[k] + heights[k + 1]) / 2
        a, b = np.vstack([r[:-1] for r in own]), np.vstack([r[1:] for r in own])
        hit = (a[:, 1] > y) != (b[:, 1] > y)
        x = np.sort(a[hit, 0] + (y - a[hit, 1]) * (b[hit, 0] - a[hit, 0]) / (b[hit, 1] - a[hit, 1]))
        if len(x) >= 2:
            j = int(np.argmax(x[1::2] - x[0::2]))
            out.append([(x[2 * j] + x[2 * j + 1]) / 2, y])
    return np.array(out, float).reshape(-1, 2)


def _ends(rings: list[np.ndarray]) -> np.ndarray:
    """The ends of a line's parts that an odd number of them have, as complex numbers."""
    found = np.concatenate([r[[0, -1]] for r in rings]) @ np.array([1, 1j])
    unique, times = np.unique(found, return_counts=True)
    return unique[times % 2 == 1]


class Shapes:
    """Parsed geometries (kind, owner, rings) with one index of their edges.

    Edges lie in flat arrays, shape by shape: a, b (points of a multipoint are edges of no length), whether a and b are ends
    of a line. swap: shapes that are wider than high are indexed by x instead of y.
    """

    def __init__(self, parsed: Sequence[dict]):
        a, b, a_end, b_end, inner, kinds = [], [], [], [], [], []
        for g in parsed:
            kind, rings = KINDS[g["kind"]], [np.asarray(r, float).reshape(-1, 2) for r in g["rings"]]
            kinds.append(kind)
            if kind == POINT:
                points = np.concatenate(rings)
                one, two = points, points
            else:
                rings = [r[np.append(True, (r[1:] != r[:-1]).any(axis=1))] for r in rings]
                one, two = (np.concatenate([r if len(r) == 1 else r[s] for r in rings]) for s in (slice(None, -1), slice(1, None)))
            ends = _ends(rings) if kind == LINE else np.empty(0, complex)
            a.append(one)
            b.append(two)
            a_end.append(np.isin(one @ np.array([1, 1j]), ends))
            b_end.append(np.isin(two @ np.array([1, 1j]), ends))
            inner.append(_inner_points(rings, np.asarray(g["owner"])) if kind == AREA else np.empty((0, 2)))
        self.kind = np.array(kinds)
        self.edge_at = np.concatenate([[0], np.cumsum([len(x) for x in a])])
        self.inner_at = np.concatenate([[0], np.cumsum([len(x) for x in inner])])
        self.a, self.b, self.inner = (np.concatenate(x) if x else np.empty((0, 2)) for x in (a, b, inner))
        self.a_end, self.b_end = (np.concatenate(x) if x else np.empty(0, bool) for x in (a_end, b_end))
        self._index()

    def _index(self) -> None:
        n, at = len(self.kind), self.edge_at[:-1]
        self.edge_shape = np.repeat(np.arange(n), np.diff(self.edge_at))
        low, high = np.minimum(self.a, self.b), np.maximum(self.a, self.b)
        self.low, self.high = (f.reduceat(x, at, axis=0) if n else np.empty((0, 2)) for f, x in ((np.minimum, low), (np.maximum, high)))
        self.scale = np.maximum(1.0, np.maximum(np.abs(self.low), np.abs(self.high)).max(axis=1, initial=0)) * 1e-12
        size = self.high - self.low
        self.swap = size[:, 0] > size[:, 1]
        own = self.swap[self.edge_shape]
        pick = lambda x, s: np.where(s, x[:, 0], x[:, 1])
        near = 16 * self.scale
        bottom, top = pick(low, own) - near[self.edge_shape], pick(high, own) + near[self.edge_shape]
        self.base = pick(self.low, self.swap) - near
        height = pick(self.high, self.swap) + near - self.base
        covered = np.bincount(self.edge_shape, top - bottom, n)
        edges = np.diff(self.edge_at)
        self.strips = np.clip(np.minimum(edges, SPREAD * edges * height / np.maximum(covered, 1e-300)), 1, 1 << 20).astype(np.int64)
        self.rate = self.strips / height
        self.strip_at = np.concatenate([[0], np.cumsum(self.strips)])
        self.first = self._strip(self.edge_shape, bottom)
        last = self._strip(self.edge_shape, top)
        strip, edge = ranges(self.first, last + 1)
        strip += self.strip_at[self.edge_shape[edge]]
        order = np.argsort(strip, kind="stable")
        self.edges = edge[order]
        self.entry_at = np.searchsorted(strip[order], np.arange(self.strip_at[-1] + 1))

    def _strip(self, shape: np.ndarray, height: np.ndarray) -> np.ndarray:
        return np.clip((height - self.base[shape]) * self.rate[shape], 0, self.strips[shape] - 1).astype(np.int64)

    def _near(self, shape: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For boxes low..high, each beside one shape: numbers of boxes, and edges whose boxes meet them, each once; in parts."""
        if not len(shape):
            return
        axis = self.swap[shape]
        pick = lambda x: np.where(axis, x[:, 0], x[:, 1])
        tall = 8 * self.scale[shape]
        low, high = low - tall[:, None], high + tall[:, None]
        meets = (low <= self.high[shape]).all(axis=1) & (high >= self.low[shape]).all(axis=1)
        first = self._strip(shape, pick(low))
        last = np.where(meets, self._strip(shape, pick(high)), first - 1)
        base = self.strip_at[shape]
        entries = np.where(meets, self.entry_at[base + last + 1] - self.entry_at[base + first], 0)
        parts = np.cumsum(entries) // STEP
        starts = np.flatnonzero(np.append(True, parts[1:] != parts[:-1]))
        for start, stop in zip(starts, np.append(starts[1:], len(shape)), strict=True):
            strip, box = ranges(first[start:stop], last[start:stop] + 1)
            box += start
            entry, at = ranges(self.entry_at[base[box] + strip], self.entry_at[base[box] + strip + 1])
            edge, box, strip = self.edges[entry], box[at], strip[at]
            keep = strip == np.maximum(self.first[edge], first[box])  # in the first strip that both touch
            edge, box = edge[keep], box[keep]
            lo, hi = np.minimum(self.a[edge], self.b[edge]), np.maximum(self.a[edge], self.b[edge])
            keep = (lo <= high[box]).all(axis=1) & (hi >= low[box]).all(axis=1)
            yield box[keep], edge[keep]

    def where(self, shape: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Place of each point in the shape beside it."""
        on, at_end, odd = np.zeros(len(p), bool), np.zeros(len(p), bool), np.zeros(len(p), np.int64)
        for k, e in self._near(shape, p, p):
            a, d, x = self.a[e], self.b[e] - self.a[e], p[k] - self.a[e]
            square = (d**2).sum(axis=1)
            along = np.clip((x * d).sum(axis=1) / np.maximum(square, 1e-300), 0, 1)
            off = np.abs(x - along[:, None] * d).max(axis=1)
            limit = self.scale[shape[k]]
            on[k[off <= 8 * limit]] = True
            for point, end in ((self.a[e], self.a_end[e]), (self.b[e], self.b_end[e])):
                at_end[k[end & (np.abs(p[k] - point).max(axis=1) <= limit)]] = True
        areas = np.flatnonzero(self.kind[shape] == AREA)
        if len(areas):
            own, q = shape[areas], p[areas]
            wide = self.swap[own]
            # the ray runs across the strips' axis, so its box is the point's strip, and the shape's far side
            far = np.where(wide[:, None], np.column_stack([q[:, 0], self.high[own, 1]]), np.column_stack([self.high[own, 0], q[:, 1]]))
            for k, e in self._near(own, q, np.maximum(q, far)):
                turn = wide[k]
                flip = lambda x, t: np.where(t[:, None], x[:, ::-1], x)
                a, b, x = flip(self.a[e], turn), flip(self.b[e], turn), flip(q[k], turn)
                crosses = (a[:, 1] > x[:, 1]) != (b[:, 1] > x[:, 1])
                with np.errstate(divide="ignore", invalid="ignore"):
                    at = a[:, 0] + (x[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
                odd += np.bincount(areas[k[crosses & (x[:, 0] < at)]], minlength=len(p))
        kind = self.kind[shape]
        line = np.where(at_end, BOUNDARY, np.where(on, INSIDE, OUTSIDE))
        area = np.where(on, BOUNDARY, np.where(odd % 2 == 1, INSIDE, OUTSIDE))
        return np.where(kind == AREA, area, np.where(kind == LINE, line, np.where(on, INSIDE, OUTSIDE)))

    def pieces(self, edges: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Edges cut by the shape beside each: middles of the pieces and the number of their edge; places where an edge
        meets one of the shape's edges at an angle, and the number of its edge."""
        a, d = self.a[edges], self.b[edges] - self.a[edges]
        square = np.maximum((d**2).sum(axis=1), 1e-300)
        number, cut, places, of = [np.tile(np.arange(len(edges)), 2)], [np.repeat([0.0, 1.0], len(edges))], [], []
        low, high = np.minimum(a, a + d), np.maximum(a, a + d)
        for k, f in self._near(shape, low, high):
            g, w = self.b[f] - self.a[f], self.a[f] - a[k]
            cross = d[k, 0] * g[:, 1] - d[k, 1] * g[:, 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                t = (w[:, 0] * g[:, 1] - w[:, 1] * g[:, 0]) / cross
                u = (w[:, 0] * d[k, 1] - w[:, 1] * d[k, 0]) / cross
            hit = (cross != 0) & (u >= -1e-12) & (u <= 1 + 1e-12) & (t > 0) & (t < 1)
            number.append(k[hit])
            cut.append(t[hit])
            hit = (cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
            places.append(a[k[hit]] + t[hit, None] * d[k[hit]])
            of.append(k[hit])
            for point in (self.a[f], self.b[f]):
                x = point - a[k]
                along = (x * d[k]).sum(axis=1) / square[k]
                near = np.abs(x - along[:, None] * d[k]).max(axis=1) <= 8 * self.scale[shape[k]]
                hit = near & (along > 0) & (along < 1)
                number.append(k[hit])
                cut.append(along[hit])
        number, cut = np.concatenate(number), np.concatenate(cut)
        order = np.lexsort((cut, number))
        number, cut = number[order], cut[order]
        whole = (number[1:] == number[:-1]) & (np.diff(cut) > 1e-13)
        own, middle = number[1:][whole], (cut[1:] + cut[:-1])[whole] / 2
        return a[own] + middle[:, None] * d[own], own, np.concatenate(places) if places else np.empty((0, 2)), np.concatenate(of) if of else np.empty(0, np.int64)

    def _parts(self, s: np.ndarray, t: np.ndarray) -> dict[str, np.ndarray]:
        """For pairs of shapes: which places in t the interior and the boundary of s have (a row of three for each pair),
        whether a piece of s lies inside t, and whether s and t are lines that meet inside both."""
        n = len(s)
        inner, outer = np.zeros((n, 3), bool), np.zeros((n, 3), bool)
        run, meet = np.zeros(n, bool), np.zeros(n, bool)
        kind, counted = self.kind[s], np.zeros(n, np.int64)
        for pair, edge in self._near(s, self.low[t], self.high[t]):
            counted += np.bincount(pair, minlength=n)
            points = kind[pair] == POINT
            inner[pair[points], self.where(t[pair[points]], self.a[edge[points]])] = True
            pair, edge = pair[~points], edge[~points]
            area = kind[pair] == AREA
            middles, own, places, of = self.pieces(edge, t[pair])
            found = self.where(t[pair[own]], middles)
            for part, mine in ((inner, ~area[own]), (outer, area[own])):
                part[pair[own][mine], found[mine]] = True
            run[pair[own][~area[own] & (found == INSIDE)]] = True
            lines = (kind[pair[of]] == LINE) & (self.kind[t[pair[of]]] == LINE)
            places, of = places[lines], pair[of[lines]]
            meet[of[(self.where(s[of], places) == INSIDE) & (self.where(t[of], places) == INSIDE)]] = True
            for point, end in ((self.a[edge], self.a_end[edge]), (self.b[edge], self.b_end[edge])):
                found = self.where(t[pair], point)
                inside = ~area & ~end
                inner[pair[inside], found[inside]] = True
                outer[pair[~inside], found[~inside]] = True
        beyond = counted < np.diff(self.edge_at)[s]  # edges that don't meet t's box
        inner[beyond & (kind != AREA), OUTSIDE] = True
        outer[beyond & (kind == AREA), OUTSIDE] = True
        point, pair = ranges(self.inner_at[s], self.inner_at[s + 1])
        inner[pair, self.where(t[pair], self.inner[point])] = True
        return {"inner": inner, "outer": outer, "run": run, "meet": meet}

    def relations(self, one: np.ndarray, two: np.ndarray) -> dict[str, np.ndarray]:
        """Each relation of NAMES between the shapes one[i] and two[i]."""
        first, second = self._parts(one, two), self._parts(two, one)
        i1, b1, i2, b2 = first["inner"], first["outer"], second["inner"], second["outer"]
        k1, k2 = self.kind[one], self.kind[two]
        ii = i1[:, INSIDE] | i2[:, INSIDE]
        both = (k1 == AREA) & (k2 == AREA)
        ii |= both & (b1[:, INSIDE] | b2[:, INSIDE])
        ii = np.where((k1 == LINE) & (k2 == AREA), i1[:, INSIDE], np.where((k1 == AREA) & (k2 == LINE), i2[:, INSIDE], ii))
        ii |= first["meet"] & (k1 == LINE) & (k2 == LINE)
        meets = ii | (i1 | b1 | i2 | b2)[:, BOUNDARY:].any(axis=1)
        out1, out2 = (x[:, OUTSIDE] | y[:, OUTSIDE] for x, y in ((i1, b1), (i2, b2)))
        # an inner part may stand out although no boundary does: a hole of the other
        out1, out2 = out1 | (both & b2[:, INSIDE]) | (k1 > k2), out2 | (both & b1[:, INSIDE]) | (k2 > k1)
        shared = ii & ((k1 != LINE) | (k2 != LINE) | first["run"])
        return {
            "contains": ii & ~out2,
            "within": ii & ~out1,
            "intersects": meets,
            "overlaps": (k1 == k2) & ii & out1 & out2 & shared,
            "crosses": ii & (((k1 < k2) & out1) | ((k2 < k1) & out2) | ((k1 == LINE) & (k2 == LINE) & ~shared)),
        }


def relations(ones: Sequence[dict], twos: Sequence[dict]) -> dict[str, np.ndarray]:
    """Each relation of NAMES between the parsed geometries ones[i] and twos[i]; equal ones are indexed once."""
    place: dict[tuple, int] = {}
    kept: list[dict] = []

    def number(g: dict) -> int:
        key = (g["kind"], tuple(g["owner"]), *(np.asarray(r, float).tobytes() for r in g["rings"]))
        if key not in place:
            place[key] = len(kept)
            kept.append(g)
        return place[key]

    one, two = (np.array([number(g) for g in side], np.int64) for side in (ones, twos))
    if not len(one):
        return {name: np.empty(0, bool) for name in NAMES}
    return Shapes(kept).relations(one, two)
