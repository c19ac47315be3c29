"""Functions on terms' values that Spark's own don't cover by name: SPARQL's builtins, and helpers for IRIs and labels.

An error is null throughout, as an error in a filter isn't true. Builtins that Spark has under another name are listed in
BUILTINS, so that a query can be written with either.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.geodesy import distance
from graphloom.functions.geometry import PREDICATES, geometry
from graphloom.functions.terms import NUMERIC, XSD, Const, TermType
from graphloom.operators.solutions import Solutions


def round_half_up(x: Column) -> Column:
    """Halves go towards positive infinity: -2.5 gives -2."""
    return F.floor(x + F.lit(0.5))


def divide(a: Column, b: Column) -> Column:
    """Never truncates; by zero it is an error."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def str_before(text: Column, part: Column) -> Column:
    at = F.position(part, text)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(F.lit(""))


def str_after(text: Column, part: Column) -> Column:
    at = F.position(part, text)
    return F.when(at > 0, F.substring(text, at + F.char_length(part), F.char_length(text))).otherwise(F.lit(""))


def regex(text: Column, pattern: str, flags: str = "") -> Column:
    """flags: i, s, m, x."""
    return text.rlike((f"(?{flags})" if flags else "") + pattern)


def replace(text: Column, pattern: str, by: str, flags: str = "") -> Column:
    return F.regexp_replace(text, (f"(?{flags})" if flags else "") + pattern, by)


def encode_for_uri(text: Column) -> Column:
    """Per cent codes for all but unreserved characters."""
    coded = F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    return F.replace(coded, F.lit("%7E"), F.lit("~"))


def lang_matches(tag: Column, wanted: str) -> Column:
    if wanted == "*":
        return F.coalesce(tag, F.lit("")) != ""
    return (F.lower(tag) == wanted.lower()) | F.startswith(F.lower(tag), F.lit(wanted.lower() + "-"))


def truth(value: Column, shape: TermType) -> Column:
    """The effective boolean value; null where a term has none."""
    if shape.kind != "literal":
        return F.lit(None).cast("boolean")
    if shape.datatype in NUMERIC:
        number = value.cast("double")
        return F.when(number.isNotNull(), (number != 0) & ~F.isnan(number))
    if shape.datatype and shape.datatype.endswith("#boolean"):
        return value.cast("boolean")
    return F.char_length(value) > 0 if shape.datatype is None else F.lit(None).cast("boolean")


def datatype(solutions: Solutions, name: str) -> Column:
    """DATATYPE: static where the variable's shape is; xsd:string for plain literals, rdf:langString with a language."""
    v = solutions.vars[name]
    plain, tagged = F.lit("http://www.w3.org/2001/XMLSchema#string"), F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")
    if v.shape.kind == "any":
        c = v.value
        return F.when(c["kind"] == "literal", F.coalesce(c["datatype"], F.when(c["lang"].isNotNull(), tagged).otherwise(plain)))
    return F.when(v.bound, F.lit(v.shape.datatype) if v.shape.datatype else tagged if v.shape.lang else plain) if v.shape.kind == "literal" else F.lit(None).cast("string")


def lang(solutions: Solutions, name: str) -> Column:
    v = solutions.vars[name]
    if v.shape.kind == "any":
        return F.when(v.value["kind"] == "literal", F.coalesce(v.value["lang"], F.lit("")))
    return F.when(v.bound, F.lit(v.shape.lang or "")) if v.shape.kind == "literal" else F.lit(None).cast("string")


def is_kind(solutions: Solutions, name: str, kind: str) -> Column:
    """isIRI, isLiteral, isBlank by kind: iri, literal, bnode. Unbound is an error."""
    v = solutions.vars[name]
    return v.value["kind"] == kind if v.shape.kind == "any" else F.when(v.bound, F.lit(v.shape.kind == kind))


def is_numeric(solutions: Solutions, name: str) -> Column:
    v = solutions.vars[name]
    if v.shape.kind == "any":
        c = v.value
        return (c["kind"] == "literal") & F.coalesce(c["datatype"].isin(*NUMERIC), F.lit(False)) & c["value"].try_cast("double").isNotNull()
    return F.when(v.bound, F.lit(v.shape.kind == "literal" and v.shape.datatype in NUMERIC))


def seconds(x: Column) -> Column:
    """Seconds with their fraction."""
    return F.extract(F.lit("SECOND"), x).cast("decimal(8,6)")


def zone(lexical: Column) -> Column:
    """TZ: the zone of a dateTime's text, ``Z``, ``+hh:mm`` or ``-hh:mm``; empty without one."""
    return F.when(lexical.isNotNull(), F.regexp_extract(lexical, r"T.*(Z|[+-][0-9]{2}:[0-9]{2})$", 1))


def zone_duration(lexical: Column) -> Column:
    """TIMEZONE: the zone as a dayTimeDuration; an error without one."""
    z = zone(lexical)
    hours, minutes = (F.regexp_extract(z, r"^[+-]([0-9]{2}):([0-9]{2})$", i).try_cast("int") for i in (1, 2))
    parts = F.concat(F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
    far = F.concat(F.when(F.startswith(z, F.lit("-")), "-").otherwise(""), F.lit("PT"), parts)
    return F.when((z == "Z") | (hours + minutes == 0), "PT0S").when(z != "", far)


def uuid_iri() -> Column:
    return F.concat(F.lit("urn:uuid:"), F.uuid())


def _term(kind: str, value: Column, datatype: Column | None = None, lang: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    whole = F.struct(F.lit(kind).alias("kind"), value.alias("value"), (none if datatype is None else datatype).alias("datatype"), (none if lang is None else lang).alias("lang"))
    return F.when(value.isNotNull() & (F.lit(True) if datatype is None else datatype.isNotNull()) & (F.lit(True) if lang is None else lang.isNotNull()), whole)


def iri(text: Column, base: str = "") -> Column:
    """IRI: a dynamic term; a relative reference is put behind the base."""
    return _term("iri", F.when(text.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), text).otherwise(F.concat(F.lit(base), text)))


def bnode(label: Column | None = None) -> Column:
    """BNODE: a dynamic term, the same for equal labels in one solution's sources; a fresh one without a label."""
    return _term("bnode", F.concat(F.lit("b"), F.uuid() if label is None else F.sha1(label)))


def str_dt(text: Column, datatype: Column) -> Column:
    return _term("literal", text, datatype=datatype)


def str_lang(text: Column, tag: Column) -> Column:
    return _term("literal", text, lang=F.lower(tag))


def same_term(a: Const, b: Const) -> bool:
    return (a.kind, a.value, a.datatype, a.lang) == (b.kind, b.value, b.datatype, b.lang)


#: SPARQL's names and what they are here.
BUILTINS: dict[str, Callable[..., Column]] = {
    "STRLEN": F.char_length, "UCASE": F.upper, "LCASE": F.lower, "SUBSTR": F.substring, "STRSTARTS": F.startswith, "STRENDS": F.endswith, "CONTAINS": F.contains,
    "STRBEFORE": str_before, "STRAFTER": str_after, "CONCAT": F.concat, "REGEX": regex, "REPLACE": replace, "ENCODE_FOR_URI": encode_for_uri, "LANGMATCHES": lang_matches,
    "ABS": F.abs, "CEIL": F.ceil, "FLOOR": F.floor, "ROUND": round_half_up, "RAND": F.rand, "IF": lambda c, a, b: F.when(c, a).otherwise(b), "COALESCE": F.coalesce,
    "NOW": F.current_timestamp, "YEAR": F.year, "MONTH": F.month, "DAY": F.day, "HOURS": F.hour, "MINUTES": F.minute, "SECONDS": seconds, "TZ": zone, "TIMEZONE": zone_duration,
    "MD5": F.md5, "SHA1": F.sha1, "SHA256": lambda c: F.sha2(c, 256), "SHA384": lambda c: F.sha2(c, 384), "SHA512": lambda c: F.sha2(c, 512), "UUID": uuid_iri, "STRUUID": F.uuid,
    "BOUND": Column.isNotNull, "IRI": iri, "URI": iri, "BNODE": bnode, "STRDT": str_dt, "STRLANG": str_lang,
}

_GEOF = "http://www.opengis.net/def/function/geosparql/"
_FN = "http://www.w3.org/2005/xpath-functions#"


def _spatially(name: str) -> Callable[[Column, Column], Column]:
    return lambda a, b: PREDICATES[name](geometry(a), geometry(b))


#: Functions by IRI: spatial ones on geometries' texts, casts by datatype, and the builtins that have an IRI elsewhere.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    **{f"{_GEOF}sf{n.capitalize()}": _spatially(n) for n in PREDICATES},
    f"{_GEOF}sfDistance": lambda a, b: distance(geometry(a), geometry(b)),
    **{XSD + n: (lambda x, k=k: x.try_cast(k)) for n, k in (("integer", "bigint"), ("double", "double"), ("float", "float"), ("decimal", "decimal(38,18)"), ("boolean", "boolean"), ("dateTime", "timestamp"), ("string", "string"))},
    **{_FN + n: BUILTINS[b] for n, b in (("string-length", "STRLEN"), ("upper-case", "UCASE"), ("lower-case", "LCASE"), ("contains", "CONTAINS"), ("starts-with", "STRSTARTS"), ("ends-with", "STRENDS"), ("abs", "ABS"), ("ceiling", "CEIL"), ("floor", "FLOOR"), ("concat", "CONCAT"))},
}


def function(name: str) -> Callable[..., Column]:
    """A function by its IRI, or a builtin by its name in any case."""
    found = FUNCTIONS.get(name) or BUILTINS.get(name.upper())
    if found is None:
        raise LookupError(f"no function {name}")
    return found


# ---- IRIs, labels and run metadata


def local_name(iri: Column) -> Column:
    """What follows the last ``/`` or ``#``, per cent codes decoded; marks at the end don't count."""
    text = F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(iri, F.lit("+"), F.lit("%2B"))), iri), "[/#]+$", "")
    return F.coalesce(F.nullif(F.regexp_extract(text, "[^/#]+$", 0), F.lit("")), text)


def base_url(url: Column) -> Column:
    """A URL without its parameters."""
    return F.substring_index(url, "?", 1)


def is_coverage(url: Column) -> Column:
    """Whether a URL asks a coverage service."""
    query = F.lower(F.coalesce(F.parse_url(url, F.lit("QUERY")), F.lit("")))
    return query.rlike("(^|&)(service=wcs|request=getcoverage)(&|$)")


def merged_parameters(urls: list[str]) -> str:
    """One URL with the parameters of several that have one base; other bases are an error."""
    bases = {u.partition("?")[0] for u in urls}
    if len(bases) != 1:
        raise ValueError(f"not one base: {sorted(bases)}")
    parameters = dict.fromkeys(p for u in urls for p in u.partition("?")[2].split("&") if p)
    return bases.pop() + ("?" + "&".join(parameters) if parameters else "")


def search_text(name: Column) -> Column:
    """A name as words: camel case and separators parted, runs of spaces squeezed."""
    parted = F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(parted, r"[_\-.:/\\]+", " "), r"\s+", " "))


def safe_fragment(name: Column, default: str = "NewClass") -> Column:
    """A name fit for an IRI: what is neither a letter nor a number, of any script, becomes ``_``."""
    text = F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}]+", "_"), F.lit("_"))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(default)).otherwise(text)


def listed(titles: Column, most: int = 5) -> Column:
    """The first titles and how many more there are."""
    rest = F.size(titles) - most
    shown = F.array_join(F.slice(titles, 1, most), ", ")
    return F.when(rest > 0, F.concat(shown, F.lit(" And "), rest.cast("string"), F.lit(" more"))).otherwise(shown)


def query_metadata(text: Column) -> Column:
    """Digest, bytes, and how many spatial functions a query's text calls."""
    return F.struct(F.sha2(text, 256).alias("sha256"), F.octet_length(text).alias("bytes"), F.regexp_count(text, F.lit(r"geof:\w+\s*\(")).alias("spatial_functions"))


def log_level(line: Column) -> Column:
    """info, success, warning or error by a leading mark in brackets; lines without one are info."""
    level = F.lower(F.regexp_extract(line, r"(?i)^\[(INFO|SUCCESS|WARNING|WARN|ERROR)\]", 1))
    return F.when(level.isin("warn", "warning"), "warning").when(level.isin("success", "error"), level).otherwise("info")


def log_message(line: Column) -> Column:
    return F.regexp_replace(line, r"(?i)^\[(INFO|SUCCESS|WARNING|WARN|ERROR)\]\s*", "")


def compact(kind: Column, value: Column) -> Column:
    """A cell as a reader wants it: an IRI's local name (marks at its end don't count), other values as they are."""
    return F.when(kind == "uri", F.coalesce(F.nullif(local_name(value), F.lit("")), value)).otherwise(F.coalesce(value, F.lit("")))
