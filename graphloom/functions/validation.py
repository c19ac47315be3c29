"""JSON values against a schema: one Column over VARIANT that tells the first thing that is wrong, and where.

Of a schema these count: type (object, array, string, number, integer, boolean, null), required, properties,
additionalProperties (only false), items, enum. Faults are looked for in this order: the type, missing fields, fields that
shouldn't be there, the properties in the schema's order, items from the first on, the enumeration.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What schema_of_variant() says of the types.
_KINDS = {
    "object": "^OBJECT<", "array": "^ARRAY<", "string": "^STRING$", "boolean": "^BOOLEAN$", "null": "^VOID$",
    "number": "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL.*|DOUBLE|FLOAT)$", "integer": "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\\([0-9]+,0\\))$",
}


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _texts(names: list[str]) -> Column:
    return F.array(*map(F.lit, names)).cast("array<string>")


def fault(value: Column, schema: dict, path: Column | str = "$") -> Column:
    """The first fault of a VARIANT, as a text that begins with its path; null if there is none.

    Null (no VARIANT at all) is a fault of its own: such a text was no JSON.
    """
    return F.when(value.isNull(), _join(path, " is no JSON.")).otherwise(_fault(value, schema, F.lit(path) if isinstance(path, str) else path))


def _fault(value: Column, schema: dict, path: Column) -> Column:
    faults: list[Column] = []
    kind = schema.get("type")
    if kind in _KINDS:
        faults.append(F.when(~F.schema_of_variant(value).rlike(_KINDS[kind]), _join(path, f" must be a JSON {kind}.")))
    if kind == "object":
        fields = F.try_variant_get(value, "$", "map<string,variant>")
        names, listed = F.map_keys(fields), schema.get("properties", {})
        if schema.get("required"):
            missing = F.array_except(_texts(schema["required"]), names)
            faults.append(F.when(F.size(missing) > 0, _join(path, " is missing required field(s): ", F.array_join(missing, ", "), ".")))
        if schema.get("additionalProperties") is False:
            more = F.array_sort(F.array_except(names, _texts(list(listed))))
            faults.append(F.when(F.size(more) > 0, _join(path, " has unexpected field(s): ", F.array_join(more, ", "), ".")))
        for name, own in listed.items():
            inner = F.try_element_at(fields, F.lit(name))
            faults.append(F.when(inner.isNotNull(), _fault(inner, own, _join(path, f".{name}"))))
    if kind == "array" and schema.get("items"):
        each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x, i: _fault(x, schema["items"], _join(path, "[", i.cast("string"), "]")))
        faults.append(F.get(F.filter(each, Column.isNotNull), F.lit(0)))
    if "enum" in schema:
        allowed = [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in schema["enum"]]
        faults.append(F.when(~F.to_json(value).isin(allowed), _join(path, f" must be one of: {', '.join(map(str, schema['enum']))}.")))
    return F.coalesce(*faults) if faults else F.lit(None).cast("string")


def fault_path(found: Column) -> Column:
    """Where a fault is."""
    return F.when(found.isNotNull(), F.regexp_extract(found, r"^(\S+)", 1))


def is_raster(text: Column) -> Column:
    """Whether a text is a raster's description: an object with an image and four corners of two numbers each."""
    corner = {"type": "array", "items": {"type": "number"}}
    value = F.try_parse_json(text)
    sound = fault(value, {"type": "object", "required": ["image", "corners"], "properties": {"image": {"type": "string"}, "corners": {"type": "array", "items": corner}}}).isNull()
    corners = F.try_variant_get(value, "$.corners", "array<array<double>>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    four = (F.size(corners) == 4) & F.forall(corners, lambda c: (F.size(c) == 2) & F.forall(c, finite))
    return F.coalesce(sound & four, F.lit(False))

