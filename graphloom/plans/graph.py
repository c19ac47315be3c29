"""Graph patterns over mapped sources as DataFrames.

match() picks the rules that can contribute, groups patterns by subject, and answers each star by one scan where the
mapping says that its subjects are unique: no self-joins are left for Catalyst. Where they aren't, what a subject's own
columns fix needs no self-join either. Constants are turned into conditions on the columns they come from, so they reach the
scan; shared IRIs become equalities of keys.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import replace
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.geodesy import buffered
from graphloom.functions.geometry import envelope, geometry
from graphloom.functions.terms import GEOMETRY, Const, Ref, Template, TermType, compatible, constant, dynamic, shape_of, typed
from graphloom.operators.closure import closure
from graphloom.operators.durable import durable
from graphloom.operators.solutions import Solutions, Var
from graphloom.operators.spatial import Relation, related, spatial_filter
from graphloom.plans import rules as selection
from graphloom.plans.paths import Alt, Inv, Maybe, Path, Plus, Seq, Star
from graphloom.plans.rules import is_var
from graphloom.sources.answers import Answers, Box
from graphloom.sources.mapping import Parent, Rule, TriplesMap, rules_of
from graphloom.sources.paths import iterate, value


#: A part that rows are dealt to holds so many, if they are even, and at least so many keys.
_PART, _KEYS = 1 << 19, 1 << 10


def _typed(shape: TermType, x: Column) -> Column:
    return typed(x, shape)


class VirtualGraph:
    """maps: the mapping. order: ``static`` (by score), or ``random`` with a seed. push: constants reach the scans.

    Remote sources are asked by constants, and by the values or boxes that the solutions so far bind, however many there
    are: executors ask. answers: what they have answered (several graphs may share it).
    """

    def __init__(self, spark: SparkSession, maps: Sequence[TriplesMap], order: str = "static", seed: int = 42, push: bool = True, select: str = "unification", answers: Answers | None = None):
        self.spark, self.order, self.seed, self.push = spark, order, seed, push
        self.maps = {m.name: m for m in maps}
        self.rules = rules_of(list(maps))
        self.choose = {"unification": selection.candidates, "star": selection.by_star, "pattern": selection.by_pattern}[select]
        self.subjects = {m.name: m.subject for m in maps}
        self.answers = answers or Answers()
        self._rows: dict[str, DataFrame] = {}
        self._counts: dict[str, int] = {}
        self._ask: dict[str, tuple[str, DataFrame]] = {}
        self._near: dict[str, Box] = {}
        self._drafting = False
        self._fresh = 0

    # ---- patterns

    def match(self, *patterns: Sequence, spatial: dict[str, bool] | None = None, where: Sequence[Relation] = (), smallest: float = 0.01) -> Solutions:
        """Solutions of a basic graph pattern. A position is "?name", a Const, or (object) a Python value; a predicate
        may be a Path. spatial: geometry variables that filters bound, for the order of the stars.

        where: spatial constraints on geometry variables. Those with a constant are applied to the star of their
        variable; stars that share no variable are brought together by a spatial join on one that relates them, not by a
        product that is filtered. smallest: the grid's finest cell for these joins.
        """
        spatial = {f"?{n}": r.constant is not None for r in where for n in r.vars} | (spatial or {})
        self._near = self._boxes(where)
        plain, paths = [], []
        for s, p, o in patterns:
            o = o if isinstance(o, Const) or is_var(o) else Const.literal(o)
            (paths if isinstance(p, Path) else plain).append((s, p, o))
        stars = self._stars(plain, spatial or {}) if plain else []
        left = list(where)

        def applied(part: Solutions, relations: Sequence[Relation]) -> Solutions:
            for r in relations:
                part = spatial_filter(part, r.predicate, r.a, r.b, r.constant, r.metres, r.closed)
            return part

        def fitting(part: Solutions) -> list[Relation]:
            """The constraints, of those left, that the part binds all variables of."""
            own = [r for r in left if r.vars <= set(part.vars)]
            left[:] = [r for r in left if r not in own]
            return own

        rest = [(self._draft(star), star) for star in stars] + [(self._path(*p), None) for p in paths]
        rest = [(part, star, fitting(part)) for part, star in rest]
        rest, later = self._apart(rest, left, applied)

        def real(part: Solutions, star: tuple | None, own: Sequence[Relation]) -> Solutions:
            return applied(self._star(*star) if star is not None and self._remote(star) else part, own)

        out = real(*rest.pop(0))

        def taken(k: int, relations: Sequence[Relation]) -> Solutions:
            """The k-th of the rest; a remote source is asked by what the solutions so far bind, where it can be."""
            nonlocal out
            part, star, own = rest.pop(k)
            if star is not None and self.push:
                out, asked = self._asked(out, star, relations)
                if asked is not None:
                    return applied(asked, own)
            return real(part, star, own)

        while rest:  # stay connected where the pattern is
            k = next((k for k, (part, *_) in enumerate(rest) if set(part.vars) & set(out.vars)), None)
            if k is not None:
                part = taken(k, ())
                out = out.join(part)
                out = applied(out, fitting(out))
                continue
            between = [[r for r in left if r.vars <= set(out.vars) | set(part.vars)] for part, *_ in rest]
            near = [k for k, found in enumerate(between) if found]
            k = min(near, key=lambda k: any(r.metres is not None for r in between[k]), default=None)  # areas hold fewer pairs
            if k is None:
                out = out.join(real(*rest.pop(0)))
                continue
            left[:] = [r for r in left if r not in between[k]]
            part = taken(k, between[k])
            out = related(out, part, between[k], smallest)
            out = applied(out, fitting(out))
        if left:
            raise ValueError(f"no pattern binds the variables of {left}")
        return reduce(Solutions.join, later, out)

    def _apart(self, parts: list[tuple], relations: Sequence[Relation], applied) -> tuple[list[tuple], list[Solutions]]:
        """Parts without those that hang on a single one of those that space relates, which keeps what these leave of it; and
        these, to be joined last: spatial joins then neither write nor compare what only repeats their rows."""
        near = {n for r in relations for n in r.vars}
        bound = [set(part.vars) for part, *_ in parts]
        remote = [star is not None and self._remote(star) for _, star, _ in parts]
        hangs, later, parts = [k for k, names in enumerate(bound) if near and not near & names], [], dict(enumerate(parts))
        while hangs:
            group = [hangs.pop(0)]
            for one in group:  # grows
                more = [k for k in hangs if bound[k] & bound[one]]
                group += more
                hangs = [k for k in hangs if k not in more]
            on = [k for k in parts if k not in group and any(bound[k] & bound[g] for g in group)]
            if len(on) == 1 and not any(remote[k] for k in (*group, *on)):
                part, star, own = parts[on[0]]
                hung = reduce(Solutions.join, [applied(p, mine) for p, _, mine in map(parts.pop, group)])
                parts[on[0]] = part.exists(hung), star, own
                later.append(replace(hung, df=durable(hung.exists(applied(part, own)).df, "hung")))
        return list(parts.values()), later

    def _remote(self, star: tuple) -> bool:
        return any(r.map.source.remote is not None for part in star[1] for r in part)

    def _draft(self, star: tuple) -> Solutions:
        """A star's solutions, with no rows of remote sources: these aren't asked before it is known for what."""
        self._drafting = True
        try:
            return self._star(*star)
        finally:
            self._drafting = False

    def _asked(self, out: Solutions, star: tuple, relations: Sequence[Relation]) -> tuple[Solutions, Solutions | None]:
        """out (written, if it has been looked at) and the star's solutions from a remote source that is asked by values of
        out's variables or by boxes around its geometries; None if the source isn't remote."""
        patterns, chosen, _ = star
        maps = {r.map.name: r.map for part in chosen for r in part}
        m = next(iter(maps.values())) if len(maps) == 1 else None
        if m is None or m.source.remote is None or not all(len(part) == 1 for part in chosen):
            return out, None
        push = m.pushed()
        for (_, _, o), (rule,) in zip(patterns, chosen, strict=True):
            if not is_var(o) or not isinstance(rule.object, Ref) or rule.object.path not in push:
                continue
            near = next((r for r in relations if o[1:] in r.vars and (r.vars - {o[1:]}) & set(out.vars)), None)
            if near is None and o[1:] not in out.vars:
                continue
            out = replace(out, df=durable(out.df, "asking"))
            if near is None:
                self._ask[m.name] = rule.object.path, out.df.select(out.term(o[1:]).cast("string").alias("v")).filter("v IS NOT NULL").distinct()
            else:
                other = next(iter(near.vars - {o[1:]}))
                parsed = out.df.select(geometry(out.term(other).cast("string")).alias("g"))
                box = envelope(F.col("g"))
                box = F.when(box.isNotNull(), buffered(box, F.lit(float(near.metres)), F.col("g.srid"))) if near.metres is not None else box
                self._ask[m.name] = "bbox", parsed.select(box.alias("b")).filter("b IS NOT NULL").distinct()
            try:
                found = self._star(*star)
            finally:
                del self._ask[m.name]
            return out, found if near is None else found.distinct()  # boxes may share features; triples are a set
        return out, None

    def _boxes(self, where: Sequence[Relation]) -> dict[str, Box]:
        """Boxes around constant geometries, by the variable that has to be there."""
        found = {}
        for r in where:
            if r.constant is not None:
                box = envelope(F.col("g"))
                box = buffered(box, F.lit(float(r.metres)), F.col("g.srid")) if r.metres is not None else box
                row = self.spark.range(1).select(geometry(F.lit(r.constant)).alias("g")).filter("g.kind IS NOT NULL").select(box.alias("b")).first()
                row = row and row["b"]
                if row is not None:
                    found[r.a] = tuple(row)
        return found

    def _stars(self, patterns: list, spatial: dict[str, bool]) -> list[tuple]:
        """Patterns, their rules, and what to deal them by, subject by subject, in order."""
        chosen = dict(zip(map(tuple, patterns), self.choose(patterns, self.rules), strict=True))
        groups: dict[object, list] = {}
        for p in patterns:
            groups.setdefault(p[0], []).append(p)
        if self.order == "static":
            ordered = sorted(groups.values(), key=lambda g: -selection.score(g, spatial))
        else:
            ordered = random.Random(self.seed).sample(list(groups.values()), len(groups))
        made = [(g, [chosen[p] for p in g]) for g in ordered]
        return [(*star, self._deal(*star, made)) for star in made]

    def _fixed(self, rule: Rule) -> bool:
        """Whether a subject's IRI fixes the object: the object has no columns but those that fill the IRI."""
        subject, term = rule.map.subject, selection.object_of(rule, self.subjects)
        if not isinstance(subject, Template) or isinstance(rule.object, Parent) and rule.object.on:
            return False
        refs = term.refs if isinstance(term, Template) else (term.path,) if isinstance(term, Ref) else ()
        if not set(refs) <= set(subject.refs):
            return False
        drafting, self._drafting = self._drafting, True  # a service isn't asked for its columns' types
        try:
            return subject.keyed([f.dataType for f in self._source(rule.map).select(*self._columns(subject)).schema.fields])
        finally:
            self._drafting = drafting

    def _deal(self, star: list, chosen: list[list[Rule]], stars: list[tuple]) -> tuple[str, int] | None:
        """What to deal a star's rows by before repeats are dropped, and into how many parts: a variable that its subjects fix
        and that is itself the subject of many rows of a unique map, as both are joined on it next.

        Left to adaptive execution, parts grow to so many shuffled bytes; rows of few keys compress to so little that one
        task would sort and group many millions. These parts stay as they are, and their number grows with the rows.
        """
        alone = lambda part: next(iter(ms)) if all(len(p) == 1 for p in part) and len(ms := {p[0].map.name for p in part}) == 1 else None
        m = self.maps.get(alone(chosen))
        if m is None or m.unique or m.source.remote is not None or any(is_var(p) for _, p, _ in star):
            return None
        for (_, _, o), (rule,) in zip(star, chosen, strict=True):
            if not is_var(o) or not self._fixed(rule):
                continue
            other = next((self.maps.get(alone(part)) for s, part in stars if s[0][0] == o), None)
            if other is None or not other.unique or other.source.remote is not None:
                continue
            parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self._count(m) // _PART), 1)
            if self._count(other) >= parts * _KEYS:
                return o[1:], parts
        return None

    def _count(self, m: TriplesMap) -> int:
        if m.source.name not in self._counts:
            self._counts[m.source.name] = self._source(m).count()
        return self._counts[m.source.name]

    def _repeated(self, m: TriplesMap, parts: list[tuple[tuple, Rule]], deal: tuple[str, int] | None) -> Solutions:
        """A star over a map that may repeat its subjects. What a subject fixes holds for each of its rows, so that is read
        together with the first of the other patterns; only further ones are joined."""
        own = [x for x in parts if self._fixed(x[1])]
        rest = [x for x in parts if x not in own]
        first = self._scan(m, own + rest[: 1 if own else 0]) if own else None
        if first is not None and deal is not None:
            name, n = deal
            first = replace(first, df=first.df.repartition(n, *[F.col(f"`{c}`") for c in first.vars[name].columns]))
        found = ([first.distinct()] if first is not None else []) + [self._any(p, [rule]) for p, rule in rest[1 if own else 0 :]]
        return reduce(Solutions.join, found)

    def _star(self, star: list, chosen: list[list[Rule]], deal: tuple[str, int] | None = None) -> Solutions:
        maps = {r.map.name: r.map for part in chosen for r in part}
        names = list(maps)
        apart = not any(compatible(maps[a].subject, maps[b].subject) for i, a in enumerate(names) for b in names[i + 1 :])
        fixed = not any(is_var(p) for _, p, _ in star)
        if apart and fixed and maps:
            answers = []
            for name, m in maps.items():
                own = [[r for r in part if r.map.name == name] for part in chosen]
                if not all(own):
                    continue
                if m.unique and all(len(part) == 1 for part in own):
                    answers.append(self._scan(m, [(p, part[0]) for p, part in zip(star, own, strict=True)]))
                elif all(len(part) == 1 for part in own):
                    answers.append(self._repeated(m, [(p, part[0]) for p, part in zip(star, own, strict=True)], deal))
                else:
                    answers.append(reduce(Solutions.join, [self._any(p, part) for p, part in zip(star, own, strict=True)]))
            if answers:
                return reduce(Solutions.union, answers)
        return reduce(Solutions.join, [self._any(p, part) for p, part in zip(star, chosen, strict=True)])

    def _any(self, pattern, chosen: list[Rule]) -> Solutions:
        """One pattern over several rules; triples are a set."""
        if not chosen:
            return self._none(pattern)
        out = reduce(Solutions.union, [self._scan(r.map, [(pattern, r)]) for r in chosen])
        alike = any(a.predicate == b.predicate and compatible(a.map.subject, b.map.subject) and compatible(selection.object_of(a, self.subjects), selection.object_of(b, self.subjects)) for i, a in enumerate(chosen) for b in chosen[i + 1 :])
        return out.distinct() if alike or not all(r.map.unique for r in chosen) else out

    def _none(self, pattern) -> Solutions:
        names = [x[1:] for x in dict.fromkeys(pattern) if is_var(x)]
        frame = self.spark.range(0).select(*[F.lit(None).cast("string").alias(n) for n in names])
        return Solutions(frame, {n: Var(TermType("iri" if f"?{n}" == pattern[0] else "literal"), (n,), (T.StringType(),)) for n in names})

    # ---- scans

    def _source(self, m: TriplesMap, parts: Sequence[tuple[tuple, Rule]] = ()) -> DataFrame:
        """A map's rows; of a remote source those that the patterns' constants, boxes and the values to ask for leave."""
        remote = m.source.remote
        if remote is not None and self._drafting:
            return iterate(self.spark.createDataFrame([], remote.schema), m.source.iterator)
        if remote is not None:
            push = m.pushed() if self.push else {}
            own = [(o, rule.object.path) for (_, _, o), rule in parts if isinstance(rule.object, Ref) and rule.object.path in push]
            bound = {path: str(o.value) for o, path in own if isinstance(o, Const) and push[path] != "bbox"}
            boxes = [self._near[o[1:]] for o, path in own if is_var(o) and push[path] == "bbox" and o[1:] in self._near]
            if m.name in self._ask:
                rows = self.answers.each(m.source.name, remote, push, bound, *self._ask[m.name])
            else:
                rows = self.answers.one(self.spark, m.source.name, remote, push, bound, boxes[0] if boxes else None)
            return iterate(rows, m.source.iterator)
        if m.source.name not in self._rows:
            self._rows[m.source.name] = iterate(m.source.read(self.spark), m.source.iterator)
        return self._rows[m.source.name]

    def _scan(self, m: TriplesMap, parts: list[tuple[tuple, Rule]]) -> Solutions:
        """Rows of one map that answer all the patterns, each by its one rule."""
        df, conditions, late = self._source(m, parts), [], []
        held: dict[str, tuple[TermType, list[Column]]] = {}
        many: list[tuple[str, Column]] = []

        def meet(position, term, shape: TermType, columns: list[Column]) -> None:
            if is_var(position):
                name = position[1:]
                if name in held:  # met twice in one row
                    first = held[name]
                    if shape.same_value != first[0].same_value:
                        conditions.append(F.lit(False))
                        return
                    text = lambda s, c: s.template.text_of(c) if s.template else c[0]
                    conditions.append(text(*first) == text(shape, columns))
                else:
                    held[name] = (shape, columns)
            elif isinstance(term, Ref):
                (conditions if self.push else late).append(columns[0] == constant(position, shape))
            elif isinstance(term, Template):
                types = [t.dataType for t in df.select(*columns).schema.fields]
                keys = term.keys_of(str(position.value), types)
                if keys is None:
                    conditions.append(F.lit(False))
                elif self.push:
                    conditions.extend(c.cast("string") == k if not isinstance(t, (T.IntegralType, T.StringType)) else c == F.lit(k) for c, k, t in zip(columns, keys, types, strict=True))
                    conditions.append(term.text_of(columns) == F.lit(str(position.value))) if len(keys) > 1 else None
                else:
                    late.append(term.text_of(columns) == F.lit(str(position.value)))
            conditions.extend(c.isNotNull() for c in columns)

        subject = m.subject
        s_columns = self._columns(subject)
        meet(parts[0][0][0], subject, shape_of(subject), s_columns)
        for (_, p, o), rule in parts:
            if is_var(p):
                meet(p, Const(rule.predicate), TermType("iri"), [F.lit(rule.predicate)])
            if isinstance(rule.object, Parent) and rule.object.on:
                df, columns = self._with_parent(df, rule.object)
                term = self.subjects[rule.object.map]
                meet(o, term, shape_of(term), columns)
                continue
            term = selection.object_of(rule, self.subjects)
            if isinstance(term, Ref):
                column, repeated = value(term.path)
                shape = shape_of(term)
                if repeated:
                    name = f"many.{len(many)}"
                    cast = F.transform(column, partial(_typed, shape))
                    many.append((name, F.array_distinct(cast) if shape.datatype not in GEOMETRY else cast))
                    meet(o, term, shape, [F.col(f"`{name}`")])
                else:
                    meet(o, term, shape, [typed(column, shape)])
            else:
                meet(o, term, shape_of(term), self._columns(term))
        return self._answer(df, held, many, conditions, late)

    def _answer(self, df: DataFrame, held, many, conditions, late) -> Solutions:
        for name, array in many:
            df = df.withColumn(name, F.explode(array))
        for c in conditions:
            df = df.filter(c)
        out, found = [], {}
        for name, (shape, columns) in held.items():
            names = (name,) if not shape.template else tuple(f"{name}.{i}" for i in range(len(columns)))
            out += [c.alias(n) for c, n in zip(columns, names, strict=True)]
            found[name] = (shape, names)
        if late:  # the ablation: constants are looked at after everything has been built
            out.append(reduce(Column.__and__, late).alias("late"))
        made = df.select(*out)
        if late:
            made = made.filter(F.coalesce("late", F.lit(False))).drop("late")
        if not held:
            made = df.select(F.lit(1).alias("one")).limit(1)
        types = {f.name: f.dataType for f in made.schema.fields}
        return Solutions(made, {n: Var(shape, names, tuple(types[c] for c in names)) for n, (shape, names) in found.items()})

    def _columns(self, term: Ref | Const | Template) -> list[Column]:
        if isinstance(term, Template):
            return [value(r)[0] for r in term.refs]
        if isinstance(term, Ref):
            return [typed(value(term.path)[0], shape_of(term))]
        return [constant(term, shape_of(term))]

    def _with_parent(self, df: DataFrame, parent: Parent) -> tuple[DataFrame, list[Column]]:
        """df joined with the distinct subjects of another map."""
        self._fresh += 1
        other = self.maps[parent.map]
        keys = self._columns(other.subject)
        named = [f"parent{self._fresh}.{i}" for i in range(len(keys))]
        joins = [f"on{self._fresh}.{i}" for i in range(len(parent.on))]
        rows = self._source(other).select(*[k.alias(n) for k, n in zip(keys, named, strict=True)], *[value(p)[0].alias(j) for (_, p), j in zip(parent.on, joins, strict=True)]).distinct()
        on = reduce(Column.__and__, [value(c)[0] == F.col(f"`{j}`") for (c, _), j in zip(parent.on, joins, strict=True)])
        return df.join(rows, on).drop(*joins), [F.col(f"`{n}`") for n in named]

    # ---- paths, graphs of triples

    def _name(self) -> str:
        self._fresh += 1
        return f"?_{self._fresh}"

    def _path(self, s, path: Path, o) -> Solutions:
        """Solutions of a property path, with the constants of its ends applied."""
        ends = [x if is_var(x) else self._name() for x in (s, o)]
        bound = [None if is_var(x) else str(x.value) for x in (s, o)]
        found = self._ends(ends[0], path, ends[1], *bound)
        for end, x in zip(ends, (s, o), strict=True):
            if not is_var(x):
                found = found.filter(lambda v, e=end, x=x: v.term(e[1:]) == F.lit(x.value))
        return found.select(*[x[1:] for x in dict.fromkeys((s, o)) if is_var(x)]) if any(map(is_var, (s, o))) else found

    def _nodes(self) -> DataFrame:
        """The IRIs of the graph's subjects and objects, a set: what a path of no step leads from and to."""
        whole = self.triples().select(F.explode(F.array("s", "o")).alias("t"))
        return whole.filter("t.kind <> 'literal'").select(F.col("t.value").alias("node")).distinct()

    def _ends(self, s: str, path: Path | Const, o: str, first: str | None = None, last: str | None = None) -> Solutions:
        """Solutions of a path between variables. first, last: the texts of constant ends, from which closures grow."""
        if isinstance(path, Const):
            return self.match((s, path, o))
        if isinstance(path, Inv):
            return self._ends(o, path.path, s, last, first)
        if isinstance(path, Seq):
            inner = [s, *[self._name() for _ in path.paths[1:]], o]
            steps = [self._ends(a, p, b) for a, p, b in zip(inner[:-1], path.paths, inner[1:], strict=True)]
            return reduce(Solutions.join, steps).select(s[1:], o[1:])
        if isinstance(path, Alt):
            return reduce(Solutions.union, [self._ends(s, p, o, first, last).select(s[1:], o[1:]) for p in path.paths])
        if isinstance(path, Plus):
            return closure(self._ends(s, path.path, o), s[1:], o[1:], None, first, last)
        if isinstance(path, (Star, Maybe)):
            fixed = [x for x in (first, last) if x is not None]
            nodes = self.spark.createDataFrame([(x,) for x in fixed[:1]], "node string") if fixed else self._nodes()
            if isinstance(path, Star):
                return closure(self._ends(s, path.path, o), s[1:], o[1:], nodes, first, last)
            step = self._ends(s, path.path, o, first, last).select(s[1:], o[1:])._plain(s[1:])._plain(o[1:])
            own = Solutions(nodes.select(F.col("node").alias(s[1:]), F.col("node").alias(o[1:])), {n[1:]: replace(step.vars[n[1:]], columns=(n[1:],)) for n in (s, o)})
            return step.union(own).distinct()
        raise TypeError(path)

    def triples(self, subject: Const | None = None) -> DataFrame:
        """All triples (s, p, o as DYNAMIC terms), or those of one subject: a description."""
        whole = self.match(("?s" if subject is None else subject, "?p", "?o"))
        return construct(whole, [("?s" if subject is None else subject, "?p", "?o")])


def construct(solutions: Solutions, template: Sequence[tuple]) -> DataFrame:
    """The set of triples that the template gives with the solutions; what has an unbound part is left out."""
    def term(x) -> Column:
        if is_var(x):
            v = solutions.vars[x[1:]]
            return v.value if v.shape.kind == "any" else dynamic(v.value, v.shape)
        x = x if isinstance(x, Const) else Const.literal(x)
        return dynamic(constant(x, shape_of(x)), shape_of(x))

    frames = [solutions.df.select(*[term(x).alias(n) for x, n in zip(t, "spo", strict=True)]) for t in template]
    return reduce(DataFrame.union, frames).na.drop().distinct()

