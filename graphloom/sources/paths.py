"""References into nested rows as native columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STEP = re.compile(r"\.\.(?P<any>[^.\[\]]+)|(?P<name>[^.\[\]]+)|\[(?P<star>\*)\]|\[\?\(@\.(?P<field>[\w.]+)\s*==\s*(?P<value>[^)]+)\)\]|\.")


def steps(path: str) -> list[tuple[str, str, str]]:
    """(kind, name or field, value) of each step: name, star, where or any. A leading ``$`` is the row itself; ``.*`` is
    ``[*]``; ``..name`` is the field of that name at any depth, of the row or behind another step."""
    out, at, text = [], 0, re.sub(r"(?<!\.)\.\*", "[*]", re.sub(r"^\$(?:\.(?!\.))?", "", path))
    while at < len(text):
        m = _STEP.match(text, at)
        if m is None:
            raise ValueError(f"{path} is no path of names, [*] and [?(@.field==value)]")
        at = m.end()
        if m["any"]:
            out.append(("any", m["any"], ""))
        elif m["name"]:
            out.append(("name", m["name"], ""))
        elif m["star"]:
            out.append(("star", "", ""))
        elif m["field"]:
            out.append(("where", m["field"], m["value"].strip().strip("'\"")))
    return out


def is_many(path: str) -> bool:
    return any(kind == "star" for kind, _, _ in steps(path))


def _first(path: str, wanted: str):
    """The first element of an array whose field is the wanted value."""

    def fits(x: Column) -> Column:
        for name in path.split("."):
            x = x[name]
        return x.cast("string") == F.lit(wanted)

    return lambda array: F.get(F.filter(array, fits), F.lit(0))


def _walk(now: Column, rest: list[tuple[str, str, str]]) -> tuple[Column, bool]:
    for i, (kind, name, wanted) in enumerate(rest):
        if kind == "name":
            now = now[name]
        elif kind == "where":
            now = _first(name, wanted)(now)
        else:
            tail = rest[i + 1 :]
            if tail:
                now = F.transform(now, lambda x: _walk(x, tail)[0])
                now = F.flatten(now) if any(k == "star" for k, _, _ in tail) else now
            return now, True
    return now, False


def value(path: str) -> tuple[Column, bool]:
    """The column of a reference, and whether it is an array of many values."""
    (kind, name, _), *rest = steps(path)
    if kind != "name":
        raise ValueError(f"{path} must begin with a name")
    return _walk(F.col(f"`{name}`"), rest)


def places(kind: T.DataType, name: str, before: str = "") -> list[str]:
    """The paths of all fields of a name in a schema, at any depth."""
    if isinstance(kind, T.ArrayType):
        return places(kind.elementType, name, f"{before}[*]")
    if not isinstance(kind, T.StructType):
        return []
    out = []
    for f in kind.fields:
        at = f"{before}.{f.name}" if before else f.name
        out += ([at] if f.name == name else []) + places(f.dataType, name, at)
    return out


def iterate(df: DataFrame, iterator: str | None) -> DataFrame:
    """One row for each element that the iterator reaches, with the element's fields as columns. A step ``..name`` comes
    first and reaches the fields of that name at any depth, those that the schema has."""
    if not iterator or not steps(iterator):
        return df
    if steps(iterator)[0][0] == "any":
        name, rest = steps(iterator)[0][1], re.sub(r"^\$?\.\.[^.\[\]]+", "", iterator)
        found = [iterate(df, at + rest) for at in places(df.schema, name)]
        if not found:
            raise ValueError(f"no field {name} at any depth")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    column, many = value(iterator)
    if not many:
        return df.select(column.alias("it")).select("it.*")
    return df.select(F.explode(column).alias("it")).select("it.*")
