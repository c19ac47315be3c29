"""Transitive closure of a path, by doubling: as many rounds as the longest shortest path has binary digits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.durable import durable
from graphloom.operators.solutions import Solutions, Var

#: Rounds of single steps from a bound end, before steps are doubled: most such searches end within them, and touch only
#: what they reach.
SINGLE = 8


def _after(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs that a pair of left and then one of right make."""
    pairs = left.alias("l").join(right.alias("r"), F.col("l.y") == F.col("r.x"))
    return pairs.select(F.col("l.x").alias("x"), F.col("r.y").alias("y")).distinct()


def reach(edges: DataFrame, seeds: DataFrame, backward: bool = False, single: int = 0) -> DataFrame:
    """From distinct edges (x, y) and seeds, a part of them: the seeds and all that more edges make of them at their end
    (at their start, if backward). A set of pairs.

    Round k joins what is known, which covers all paths up to 2^k edges, with the pairs that exactly 2^k edges link. A
    pair whose shortest path is longer passes a node at 2^k + 1 edges, so a round that finds nothing is the last. single: so
    many rounds go by one edge first, from the pairs found last; only then are edges doubled. It needs seeds that all begin
    (or, backward, end) at one node.
    """
    grow = (lambda pairs, step: _after(step, pairs)) if backward else _after
    known = frontier = seeds
    for _ in range(single):
        frontier = durable(grow(frontier, edges).join(known, ["x", "y"], "left_anti"), "frontier")
        if frontier.isEmpty():
            return known
        known = known.union(frontier)
    if single:  # what is known but for the last pairs has been followed: edges from there lead nowhere new
        inner = "y" if not backward else "x"
        outer = "x" if not backward else "y"
        done = known.join(frontier, ["x", "y"], "left_anti").select(F.col(inner).alias(outer)).distinct()
        edges = durable(edges.join(done, outer, "left_anti").select("x", "y"), "edges-left")
    step = edges
    while True:
        new = durable(grow(known, step).join(known, ["x", "y"], "left_anti"), "frontier")
        if new.isEmpty():
            return known
        known = known.union(new)
        step = durable(_after(step, step), "steps")


def closure(step: Solutions, start: str, end: str, nodes: DataFrame | None = None, first: str | None = None, last: str | None = None) -> Solutions:
    """Pairs (start, end) that one step or more lead to. A set.

    nodes: one column of nodes that are paired with themselves, too (no step). first, last: the text of the node at which
    pairs begin or end; pairs then grow from there only, instead of from all nodes. Only whether a round found
    anything comes to the driver.
    """
    a, b = step.vars[start], step.vars[end]
    same = a.shape.template and b.shape.template and a.shape.template.parts == b.shape.template.parts and len(a.columns) == 1
    same = same and a.shape.template.keyed(list(a.types)) and b.shape.template.keyed(list(b.types)) and a.types == b.types
    if not same or nodes is not None or first is not None or last is not None:  # nodes of several shapes meet as texts
        step = step._plain(start)._plain(end)
        a, b = step.vars[start], step.vars[end]
    edges = durable(step.df.select(F.col(f"`{a.columns[0]}`").alias("x"), F.col(f"`{b.columns[0]}`").alias("y")).distinct(), "edges")
    backward = first is None and last is not None
    seeds = edges.filter(F.col("x") == first) if first is not None else edges.filter(F.col("y") == last) if backward else edges
    known = reach(edges, seeds, backward, SINGLE if first is not None or backward else 0)
    if nodes is not None:
        own = nodes.select(nodes.columns[0]).toDF("x")
        own = own.filter(F.col("x") == first) if first is not None else own
        known = known.union(own.select("x", F.col("x").alias("y"))).distinct()
    known = known.filter(F.col("y") == last) if last is not None else known
    out = known.select(F.col("x").alias(a.columns[0]), F.col("y").alias(b.columns[0]))
    return Solutions(out, {start: Var(a.shape, a.columns, a.types), end: Var(b.shape, b.columns, b.types)})
