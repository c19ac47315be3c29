"""RDF terms as columns.

A variable whose terms all have one shape (an IRI template, or literals of one datatype or language) is held in native
columns, and the shape is known when the plan is built: an equality of two IRIs of one template becomes an equality of
the keys that fill it, which reaches the Parquet scan. Only variables of mixed shapes hold a struct for each term.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

XSD = "http://www.w3.org/2001/XMLSchema#"
GEO = "http://www.opengis.net/ont/geosparql#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
NUMERIC = frozenset(XSD + x for x in ("integer", "long", "int", "decimal", "float", "double", "nonNegativeInteger"))
GEOMETRY = frozenset(GEO + x for x in ("wktLiteral", "geoJSONLiteral"))
#: A term of a variable with mixed shapes.
DYNAMIC = "struct<kind:string,value:string,datatype:string,lang:string>"

_SPARK_TYPE = {XSD + k: v for k, v in {"integer": "bigint", "long": "bigint", "int": "bigint", "nonNegativeInteger": "bigint", "decimal": "decimal(38,18)", "float": "double", "double": "double", "boolean": "boolean", "string": "string", "dateTime": "timestamp", "date": "date", "gYear": "int"}.items()}


class Namespace:
    """EX = Namespace("http://ex/"); EX.name or EX["name"] is the IRI, EX + "name" its text."""

    def __init__(self, prefix: str):
        self.prefix = prefix

    def __getattr__(self, name: str) -> Const:
        if name.startswith("__"):
            raise AttributeError(name)
        return Const(self.prefix + name)

    def __getitem__(self, name: str) -> Const:
        return Const(self.prefix + name)

    def __add__(self, name: str) -> str:
        return self.prefix + name


@dataclass(frozen=True)
class Const:
    """An IRI; or a literal, if datatype or lang is given or kind says so."""

    value: str | int | float | bool
    datatype: str | None = None
    lang: str | None = None
    kind: str = "iri"

    @staticmethod
    def literal(value, datatype: str | None = None, lang: str | None = None) -> Const:
        """datatype is that of the Python value by default. xsd:string is the same as none."""
        if datatype is None and lang is None:
            datatype = {bool: XSD + "boolean", int: XSD + "integer", float: XSD + "double"}.get(type(value))
        return Const(value, None if lang or datatype == XSD + "string" else datatype, lang, "literal")


@dataclass(frozen=True)
class Ref:
    """A reference into a row: ``a.b``, ``Data[*].Valor`` (many values), ``Meta[?(@.Id==18)].Name`` (the first that fits)."""

    path: str
    datatype: str | None = None
    lang: str | None = None
    kind: str = "literal"


@dataclass(frozen=True)
class Template:
    """An IRI template such as ``http://ex/customer/{c_custkey}``."""

    text: str
    kind: str = "iri"
    parts: tuple[str, ...] = field(init=False, compare=False)
    refs: tuple[str, ...] = field(init=False, compare=False)

    def __post_init__(self):
        pieces = re.split(r"\{([^{}]+)\}", self.text)
        object.__setattr__(self, "parts", tuple(pieces[0::2]))
        object.__setattr__(self, "refs", tuple(pieces[1::2]))

    @property
    def invariant(self) -> str:
        """What stands before the first reference."""
        return self.parts[0]

    def text_of(self, keys: list[Column]) -> Column:
        pieces = [F.lit(self.parts[0])]
        for key, part in zip(keys, self.parts[1:], strict=True):
            pieces += [key.cast("string"), F.lit(part)] if part else [key.cast("string")]
        return F.concat(*pieces)

    def keys_of(self, iri: str, types: list[T.DataType]) -> list[str | int] | None:
        """The keys with which the template gives the IRI; None if there are none."""
        m = re.fullmatch("(.*)".join(map(re.escape, self.parts)), iri, re.S)
        if m is None:
            return None
        keys: list[str | int] = []
        for text, kind in zip(m.groups(), types, strict=True):
            if isinstance(kind, T.IntegralType):
                if not re.fullmatch(r"0|-?[1-9][0-9]{0,18}", text):
                    return None
                keys.append(int(text))
            else:
                keys.append(text)
        return keys

    def keyed(self, types: list[T.DataType]) -> bool:
        """Whether equal IRIs have equal keys: whole numbers parted by other characters, or a single string."""
        if len(types) == 1:
            return isinstance(types[0], (T.IntegralType, T.StringType))
        return all(isinstance(t, T.IntegralType) for t in types) and all(p and not p[0].isdigit() and p[-1] not in "-0123456789" for p in self.parts[1:-1])


@dataclass(frozen=True)
class TermType:
    """The shape of a variable's terms. kind: iri, literal, bnode, or any (a DYNAMIC struct)."""

    kind: str
    datatype: str | None = None
    lang: str | None = None
    template: Template | None = None

    @property
    def same_value(self) -> tuple:
        """Types with equal same_value have equal terms where they have equal values."""
        return self.kind, self.datatype, self.lang


def shape_of(term: Ref | Const | Template) -> TermType:
    if isinstance(term, Template):
        return TermType(term.kind, template=term)
    datatype = None if term.lang or term.datatype == XSD + "string" else term.datatype
    return TermType(term.kind, datatype if term.kind == "literal" else None, term.lang if term.kind == "literal" else None)


def typed(value: Column, shape: TermType) -> Column:
    """A reference's value as the shape's native type; what can't be cast is no term."""
    if shape.kind != "literal" or shape.datatype in GEOMETRY:
        return value if shape.datatype in GEOMETRY else value.cast("string")
    if shape.datatype is None:
        return value.cast("string")
    return value.try_cast(_SPARK_TYPE[shape.datatype]) if shape.datatype in _SPARK_TYPE else value.cast("string")


def constant(term: Const, shape: TermType) -> Column:
    """A literal or IRI constant in the native type of a shape."""
    kind = _SPARK_TYPE.get(shape.datatype or "", "string") if shape.kind == "literal" else "string"
    return F.lit(term.value).cast(kind)


def dynamic(value: Column, shape: TermType) -> Column:
    """A static term as a DYNAMIC struct; null stays null."""
    struct = F.struct(F.lit(shape.kind).alias("kind"), value.cast("string").alias("value"), F.lit(shape.datatype).cast("string").alias("datatype"), F.lit(shape.lang).cast("string").alias("lang"))
    return F.when(value.isNotNull(), struct.cast(DYNAMIC))


def compatible(pattern, term: Ref | Const | Template) -> bool:
    """Whether a pattern's position (None or a variable's name; a Const; a Template) and a rule's term can give one term.

    Exactly when the sets of terms that the two stand for can meet: two templates meet if the invariant of one is a
    prefix of the other's (and nothing else is known of their keys), a constant if the template can give it.
    """
    if pattern is None or isinstance(pattern, str):
        return True
    if isinstance(pattern, Ref) or isinstance(term, Ref):
        one, two = shape_of(pattern), shape_of(term)
        if one.kind != two.kind:
            return False
        return one.kind != "literal" or one.same_value == two.same_value
    if shape_of(pattern).kind != shape_of(term).kind:
        return False
    if isinstance(pattern, Const) and isinstance(term, Const):
        return shape_of(pattern).same_value == shape_of(term).same_value and pattern.value == term.value
    if isinstance(pattern, Template) and isinstance(term, Template):
        a, b = pattern.invariant, term.invariant
        return a.startswith(b) or b.startswith(a)
    template, const = (pattern, term) if isinstance(pattern, Template) else (term, pattern)
    return template.keys_of(str(const.value), [T.StringType()] * len(template.refs)) is not None
