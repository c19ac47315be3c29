"""Bags of solutions: one DataFrame column (or a few key columns) for each variable, and the algebra on them.

Unbound is null. A variable that OPTIONAL, UNION or VALUES may leave unbound is marked, and only joins on such variables
pay for null-tolerant compatibility: the sides are split by which of these variables are null, and each pair of parts is an
equi-join on the rest. No join here is a nested loop unless the pattern itself is a cross product.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.terms import DYNAMIC, Const, TermType, constant, dynamic, shape_of
from graphloom.operators.durable import durable


@dataclass(frozen=True)
class Var:
    """How a variable is held. A template's variable holds the keys that fill it, others hold one value."""

    shape: TermType
    columns: tuple[str, ...]
    types: tuple[T.DataType, ...]
    maybe: bool = False

    @property
    def value(self) -> Column:
        cols = [F.col(f"`{c}`") for c in self.columns]
        return self.shape.template.text_of(cols) if self.shape.template else cols[0]

    @property
    def bound(self) -> Column:
        return reduce(Column.__and__, [F.col(f"`{c}`").isNotNull() for c in self.columns])


def _both_whole(a: Sequence[T.DataType], b: Sequence[T.DataType]) -> bool:
    return all(isinstance(x, T.IntegralType) == isinstance(y, T.IntegralType) for x, y in zip(a, b, strict=True))


def equal_keys(a: Var, b: Var) -> list[tuple[Column, Column]] | None:
    """Pairs of columns that must be equal where the terms of a and b are; None if they can't be."""
    s, t = a.shape, b.shape
    if "any" in (s.kind, t.kind):
        whole = lambda v: v.value if v.shape.kind == "any" else dynamic(v.value, v.shape)
        part = lambda c: F.concat_ws("\x00", c["kind"], F.coalesce(c["datatype"], F.lit("")), F.coalesce(c["lang"], F.lit("")), c["value"])
        text = lambda v: F.when(v.value.isNotNull(), part(whole(v)))
        return [(text(a), text(b))]
    if s.same_value != t.same_value:
        return None
    if s.template and t.template:
        if s.template.parts == t.template.parts and s.template.keyed(list(a.types)) and t.template.keyed(list(b.types)) and _both_whole(a.types, b.types):
            return [(F.col(f"`{x}`"), F.col(f"`{y}`")) for x, y in zip(a.columns, b.columns, strict=True)]
        one, two = s.template.invariant, t.template.invariant
        if not (one.startswith(two) or two.startswith(one)):
            return None
    return [(a.value, b.value)]


_fresh = itertools.count()


def total(x: Column) -> Column:
    """Aggregate: the sum, 0 of no values."""
    return F.coalesce(F.sum(x), F.lit(0))


def mean(x: Column) -> Column:
    """Aggregate: the mean, 0 of no values."""
    return F.coalesce(F.avg(x), F.lit(0.0))


@dataclass(frozen=True)
class Solutions:
    df: DataFrame
    vars: dict[str, Var]

    # ---- what comes in and out

    @staticmethod
    def of(df: DataFrame, shapes: dict[str, TermType] | None = None) -> Solutions:
        """A DataFrame's columns as variables; literals of no datatype unless shapes says otherwise."""
        found = {}
        for f in df.schema.fields:
            found[f.name] = Var((shapes or {}).get(f.name, TermType("literal")), (f.name,), (f.dataType,), f.nullable)
        return Solutions(df, found)

    @staticmethod
    def values(spark: SparkSession, names: Sequence[str], rows: Sequence[Sequence]) -> Solutions:
        """Inline data. None is UNDEF; a column must hold terms of one shape, else its terms are dynamic."""
        terms = [[x if x is None or isinstance(x, Const) else Const.literal(x) for x in row] for row in rows]
        columns, found = [], {}
        for i, name in enumerate(names):
            shapes = {shape_of(row[i]) for row in terms if row[i] is not None}
            found[name] = shapes.pop() if len(shapes) == 1 else TermType("any") if shapes else TermType("literal")
            columns.append(name)

        def cell(x: Const | None, shape: TermType) -> Column:
            if x is None:
                return F.lit(None).cast(DYNAMIC if shape.kind == "any" else "string")
            return dynamic(constant(x, shape_of(x)), shape_of(x)) if shape.kind == "any" else constant(x, shape)

        one = spark.range(1)
        if terms:  # one row generator, however many rows there are
            rows_ = F.array(*[F.struct(*[cell(x, found[n]).alias(n) for n, x in zip(names, row, strict=True)]) for row in terms])
            df = one.select(F.explode(rows_).alias("row")).select("row.*")
        else:
            df = one.limit(0).select(*[F.lit(None).cast("string").alias(n) for n in names])
        maybe = {n: any(row[i] is None for row in terms) for i, n in enumerate(names)}
        return Solutions(df, {n: Var(found[n], (n,), (df.schema[n].dataType,), maybe[n]) for n in names})

    def frame(self) -> DataFrame:
        """One column for each variable. IRIs are strings, literals native, terms of mixed shapes structs."""
        return self.df.select(*[v.value.alias(n) for n, v in self.vars.items()])

    def term(self, name: str) -> Column:
        return self.vars[name].value

    def _opened(self) -> tuple[DataFrame, list[str]]:
        """df with a text column for each template's variable; their names."""
        made = [n for n, v in self.vars.items() if v.columns != (n,)]
        return self.df.withColumns({n: self.vars[n].value for n in made}), made

    def _renamed(self, mark: str) -> Solutions:
        to = {c: f"{c}{mark}" for v in self.vars.values() for c in v.columns}
        return Solutions(self.df.select(*[F.col(f"`{c}`").alias(t) for c, t in to.items()]), {n: replace(v, columns=tuple(to[c] for c in v.columns)) for n, v in self.vars.items()})

    # ---- restrictions and projections

    def filter(self, condition: Column | Callable[[Solutions], Column]) -> Solutions:
        """Keeps solutions for which the condition is true; an error or an unbound variable in it is null, so not true."""
        condition = condition(self) if callable(condition) and not isinstance(condition, Column) else condition
        df, made = self._opened()
        return replace(self, df=df.filter(condition).drop(*made))

    def bind(self, name: str, expression: Column, shape: TermType | None = None) -> Solutions:
        if name in self.vars:
            raise ValueError(f"?{name} is bound already")
        df, made = self._opened()
        df = df.withColumn(name, expression).drop(*made)
        return Solutions(df, self.vars | {name: Var(shape or TermType("literal"), (name,), (df.schema[name].dataType,), True)})

    def select(self, *names: str) -> Solutions:
        found = {n: self.vars[n] for n in names}
        return Solutions(self.df.select(*[f"`{c}`" for v in found.values() for c in v.columns]), found)

    def distinct(self) -> Solutions:
        """Keys that fill a template equal exactly where the IRIs do, if the template is keyed; else texts are compared."""
        shaped = self
        for n, v in self.vars.items():
            if v.shape.template and not v.shape.template.keyed(list(v.types)):
                shaped = shaped._plain(n)
        return replace(shaped, df=shaped.df.distinct())

    def order_by(self, *keys: Column) -> Solutions:
        """Unbound first, as for ascending keys; keys come with asc() or desc()."""
        df, made = self._opened()
        return replace(self, df=df.orderBy(*keys).drop(*made))

    def limit(self, n: int, offset: int = 0) -> Solutions:
        return replace(self, df=(self.df.offset(offset) if offset else self.df).limit(n))

    def group(self, by: Sequence[str] = (), having: Column | None = None, **aggregates: Column) -> Solutions:
        """Aggregates by variables; with none, one row whatever there is.

        total() and mean() are 0 for no values, as the algebra says; Spark's own sum and avg are unbound for them.
        """
        df, _ = self._opened()
        keys = [c for n in by for c in self.vars[n].columns]
        out = df.groupBy(*[f"`{k}`" for k in keys]).agg(*[c.alias(n) for n, c in aggregates.items()])
        out = out.filter(having) if having is not None else out
        made = {n: Var(TermType("literal"), (n,), (out.schema[n].dataType,), True) for n in aggregates}
        return Solutions(out, {n: self.vars[n] for n in by} | made)

    def ask(self) -> DataFrame:
        """One row: whether there is a solution."""
        return self.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))

    # ---- joins

    def _pairs(self, other: Solutions, names: Sequence[str]) -> list[tuple[Column, Column]] | None:
        out = []
        for n in names:
            pair = equal_keys(self.vars[n], other.vars[n])
            if pair is None:
                return None
            out += pair
        return out

    def _parts(self, names: Sequence[str]) -> list[tuple[frozenset[str], DataFrame]]:
        """df split by which of the variables, each perhaps unbound, are null."""
        maybe = [n for n in names if self.vars[n].maybe]
        out = []
        for nulls in itertools.product((False, True), repeat=len(maybe)):
            df = self.df
            for n, null in zip(maybe, nulls, strict=True):
                df = df.filter(~self.vars[n].bound if null else self.vars[n].bound)
            out.append((frozenset(n for n, null in zip(maybe, nulls, strict=True) if null), df))
        return out

    def join(self, other: Solutions) -> Solutions:
        """Compatible pairs of solutions."""
        shared = [n for n in self.vars if n in other.vars]
        right = other._renamed(f"~{next(_fresh)}")
        frames, found = [], None
        for lost, left_df in self._parts(shared):
            for gone, right_df in right._parts(shared):
                names = [n for n in shared if n not in lost | gone]
                pairs = self._pairs(right, names)
                if pairs is None:
                    joined = left_df.join(right_df, F.lit(False))
                elif pairs:
                    joined = left_df.join(right_df, reduce(Column.__and__, [a == b for a, b in pairs]))
                else:
                    joined = left_df.crossJoin(right_df)
                merged = Solutions(joined, {n: v for n, v in self.vars.items() if n not in lost} | {n: v for n, v in right.vars.items() if n not in self.vars or n in lost})
                merged = merged._tidy([*self.vars, *(n for n in other.vars if n not in self.vars)], {n for n in lost & gone})
                frames.append(merged)
        out = reduce(Solutions.union, frames)
        found = {n: replace(v, maybe=self._may(other, n)) for n, v in out.vars.items()}
        return Solutions(out.df, found)

    def _may(self, other: Solutions, n: str) -> bool:
        return all(s.vars[n].maybe for s in (self, other) if n in s.vars)

    def _tidy(self, names: Sequence[str], null: set[str]) -> Solutions:
        """Canonical column names, in order."""
        df, found = [], {}
        for n in names:
            v = self.vars[n]
            columns = (n,) if len(v.columns) == 1 and not v.shape.template else tuple(f"{n}.{i}" for i in range(len(v.columns)))
            df += [(F.lit(None).cast(t) if n in null else F.col(f"`{c}`")).alias(k) for c, k, t in zip(v.columns, columns, v.types, strict=True)]
            found[n] = replace(v, columns=columns)
        return Solutions(self.df.select(*df), found)

    def _without(self, other: Solutions, apart: bool) -> DataFrame:
        """df without solutions that have a compatible one in other. apart: unless they share no bound variable."""
        shared = [n for n in self.vars if n in other.vars]
        right = other._renamed(f"~{next(_fresh)}")
        kept = []
        for lost, df in self._parts(shared):
            for gone, right_df in right._parts(shared):
                pairs = self._pairs(right, [n for n in shared if n not in lost | gone])
                if pairs is None or not pairs and apart:
                    continue
                if pairs:
                    df = df.join(right_df, reduce(Column.__and__, [a == b for a, b in pairs]), "left_anti")
                else:
                    df = df.join(right_df.limit(1).select(F.lit(1).alias("any")), F.lit(True), "left_anti")  # one row
            kept.append(df)
        return reduce(DataFrame.union, kept)

    def minus(self, other: Solutions) -> Solutions:
        return replace(self, df=self._without(other, apart=True))

    def not_exists(self, other: Solutions) -> Solutions:
        return replace(self, df=self._without(other, apart=False))

    def exists(self, other: Solutions) -> Solutions:
        shared = [n for n in self.vars if n in other.vars]
        right = other._renamed(f"~{next(_fresh)}")
        pairs = self._pairs(right, shared)
        if any(s.vars[n].maybe for s in (self, other) for n in shared) or pairs == []:
            return replace(self, df=self._with(other, shared))
        found = F.lit(False) if pairs is None else reduce(Column.__and__, [a == b for a, b in pairs])
        return replace(self, df=self.df.join(right.df, found, "left_semi"))

    def _with(self, other: Solutions, shared: Sequence[str]) -> DataFrame:
        """df's solutions that have a compatible one in other, where shared variables may be unbound or there are none.

        Each part of df by its unbound variables loses what it has no partner for in any part of other: a solution
        stays if it isn't among those without one. Solutions that are equal row for row are alike in this.
        """
        right = other._renamed(f"~{next(_fresh)}")
        kept = []
        for lost, df in self._parts(shared):
            rest, found = df, []
            for gone, right_df in right._parts(shared):
                pairs = self._pairs(right, [n for n in shared if n not in lost | gone])
                if pairs is None:
                    continue
                on = reduce(Column.__and__, [a == b for a, b in pairs]) if pairs else F.lit(True)
                partners = right_df if pairs else right_df.limit(1).select(F.lit(1).alias("any"))  # one row
                found.append(rest.join(partners, on, "left_semi"))
                rest = rest.join(partners, on, "left_anti")
            kept += found
        return reduce(DataFrame.union, kept) if kept else self.df.filter(F.lit(False))

    def optional(self, other: Solutions, condition: Column | None = None) -> Solutions:
        """Left join. condition: over variables of both; it must be free of Python functions (bind these before)."""
        shared = [n for n in self.vars if n in other.vars]
        if any(s.vars[n].maybe for s in (self, other) for n in shared):
            if condition is not None:
                return self._optional_if(other, condition)
            return self.join(other).union(replace(self, df=self._without(other, apart=False)))
        right = other._renamed(f"~{next(_fresh)}")
        pairs = self._pairs(right, shared)
        on = F.lit(False) if pairs is None else reduce(Column.__and__, [a == b for a, b in pairs], F.lit(True))
        left_df, made = self._opened()
        right_df = right.df
        if condition is not None:
            own = [n for n in other.vars if n not in self.vars]
            right_df = right_df.withColumns({n: right.vars[n].value for n in own})
            made += own
            on = on & condition
        joined = left_df.join(right_df, on, "left").drop(*[m for m in made if m not in {c for v in (*self.vars.values(), *right.vars.values()) for c in v.columns}])
        merged = Solutions(joined, self.vars | {n: replace(v, maybe=True) for n, v in right.vars.items() if n not in self.vars})
        return merged._tidy(list(merged.vars), set())

    def _optional_if(self, other: Solutions, condition: Column) -> Solutions:
        """optional() with a condition where shared variables may be unbound: solutions are numbered, joined, filtered, and
        those whose number has no pair stay as they are. The numbers are written, so that both readings agree."""
        name = "row~optional"
        numbered = durable(self.df.withColumn(name, F.monotonically_increasing_id()), "optional")
        left = Solutions(numbered, self.vars | {name: Var(TermType("literal"), (name,), (T.LongType(),))})
        met = left.join(other).filter(condition)
        paired = met.df.select(F.col(f"`{name}`").alias("met")).distinct()
        alone = numbered.join(paired, F.col(f"`{name}`") == F.col("met"), "left_anti").drop(name)
        kept = met.select(*[n for n in met.vars if n != name])
        return kept.union(replace(self, df=alone))

    # ---- set operations

    def _plain(self, name: str) -> Solutions:
        """A template's variable as one text column."""
        v = self.vars[name]
        if not v.shape.template:
            return self
        shape = TermType(v.shape.kind)
        rest = [F.col(f"`{c}`") for n, x in self.vars.items() if n != name for c in x.columns]
        return Solutions(self.df.select(*rest, v.value.alias(name)), self.vars | {name: Var(shape, (name,), (T.StringType(),), v.maybe)})

    def _as(self, name: str, target: Var) -> Solutions:
        v = self.vars[name]
        alike = v.shape == target.shape or v.shape.template and target.shape.template and v.shape.template.parts == target.shape.template.parts
        if alike and v.columns == target.columns:
            return self
        if target.shape.kind == "any" and v.shape.kind != "any":
            rest = [F.col(f"`{c}`") for n, x in self.vars.items() if n != name for c in x.columns]
            return Solutions(self.df.select(*rest, dynamic(v.value, v.shape).alias(name)), self.vars | {name: replace(target, maybe=v.maybe)})
        return self._plain(name)

    @staticmethod
    def _common(name: str, a: Var, b: Var) -> Var:
        s, t = a.shape, b.shape
        if s.template and t.template and s.template.parts == t.template.parts and a.columns == b.columns and _both_whole(a.types, b.types):
            return a
        if "any" not in (s.kind, t.kind) and s.same_value == t.same_value:
            return Var(TermType(s.kind, s.datatype, s.lang), (name,), (T.StringType() if s.template or t.template else a.types[0],))
        return Var(TermType("any"), (name,), (T.StructType.fromDDL("kind string, value string, datatype string, lang string"),))

    def union(self, other: Solutions) -> Solutions:
        """Bag union; a variable of one side only is unbound in the other's solutions."""
        left, right = self, other
        found: dict[str, Var] = {}
        for n in [*self.vars, *(n for n in other.vars if n not in self.vars)]:
            if n in left.vars and n in right.vars:
                target = self._common(n, left.vars[n], right.vars[n])
                left, right = left._as(n, target), right._as(n, target)
                found[n] = replace(left.vars[n], maybe=self.vars[n].maybe or other.vars[n].maybe)
            else:
                found[n] = replace((left if n in left.vars else right).vars[n], maybe=True)
        return Solutions(left.df.unionByName(right.df, allowMissingColumns=True), found)

    def intersect(self, other: Solutions) -> Solutions:
        """Distinct solutions of both, over the same variables; unbound is like unbound."""
        left, right = self._aligned(other)
        return Solutions(left.df.intersect(right.df), left.vars)

    def subtract(self, other: Solutions) -> Solutions:
        """Distinct solutions of this and not of the other, over the same variables."""
        left, right = self._aligned(other)
        return Solutions(left.df.subtract(right.df), left.vars)

    def _aligned(self, other: Solutions) -> tuple[Solutions, Solutions]:
        if set(self.vars) != set(other.vars):
            raise ValueError("both sides need the same variables")
        left, right = self, other.select(*self.vars)
        for n in self.vars:
            target = self._common(n, left.vars[n], right.vars[n])
            left, right = left._as(n, target), right._as(n, target)
        names = [c for v in left.vars.values() for c in v.columns]
        cut = lambda s: Solutions(s.df.select(*[f"`{c}`" for c in names]), left.vars)
        return cut(left), cut(right)

    def mentioning(self, iri: str) -> Solutions:
        """Solutions in which any variable has the given text: the rows that go with a selected feature."""
        text = lambda v: v.value["value"] if v.shape.kind == "any" else v.value.cast("string")
        return Solutions(self.df.filter(F.exists(F.array(*[text(v) for v in self.vars.values()]), lambda x: x.eqNullSafe(F.lit(iri)))), self.vars)
