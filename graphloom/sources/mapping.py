"""Declarative mappings: which rows stand for which triples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from graphloom.functions.terms import RDF_TYPE, Const, Ref, Template
from graphloom.sources.features import FeaturesSource, answers


@dataclass(frozen=True)
class RemoteFeatures:
    """A features service: its items' URL, the columns to read, and options of the reader."""

    url: str
    schema: str
    options: tuple[tuple[str, str], ...] = ()

    def read(self, spark: SparkSession, push: dict[str, str] | None = None) -> DataFrame:
        """push: which columns' equality filters reach the URL, as column -> parameter."""
        spark.dataSource.register(FeaturesSource)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        told = dict(self.options) | {"url": self.url}
        if push:
            told["push"] = ",".join(f"{c}={p}" for c, p in sorted(push.items()))
        return spark.read.format("features").schema(self.schema).options(**told).load()

    def answers(self, requests: DataFrame, push: dict[str, str]) -> DataFrame:
        """What the service returns for each request (``key``, ``ask``), asked by the tasks that hold the requests."""
        return answers(requests, self.url, T.StructType.fromDDL(self.schema), push, dict(self.options))


@dataclass(frozen=True)
class Source:
    """Rows by name. read(spark) gives the DataFrame; iterator is a path whose array elements are the rows, if any."""

    name: str
    read: Callable[[SparkSession], DataFrame] = field(compare=False)
    iterator: str | None = None
    remote: RemoteFeatures | None = field(default=None, compare=False)

    @staticmethod
    def parquet(name: str, path: str) -> Source:
        return Source(name, lambda spark: spark.read.parquet(path))

    @staticmethod
    def sql(name: str, query: str, tables: dict[str, str] | None = None) -> Source:
        """A query over views; tables: Parquet paths of the names that it uses, in braces."""

        def read(spark: SparkSession) -> DataFrame:
            return spark.sql(query, **{n: spark.read.parquet(p) for n, p in (tables or {}).items()})

        return Source(name, read)

    @staticmethod
    def json(name: str, path: str, schema: str, iterator: str | None = None, multi_line: bool = True) -> Source:
        """Documents of a given schema: nothing is inferred, and fields that no reference needs aren't parsed."""
        return Source(name, lambda spark: spark.read.schema(schema).json(path, multiLine=multi_line), iterator)

    @staticmethod
    def features(name: str, url: str, schema: str, **options: str) -> Source:
        """A paged features service. What the maps over it declare in ``push`` reaches its URL."""
        remote = RemoteFeatures(url, schema, tuple(sorted(options.items())))
        return Source(name, remote.read, None, remote)

    @staticmethod
    def frame(name: str, make: Callable[[SparkSession], DataFrame], iterator: str | None = None) -> Source:
        return Source(name, make, iterator)


@dataclass(frozen=True)
class Parent:
    """A referencing object: the subject of another map. on: (child path, parent path) pairs; none for the same row."""

    map: str
    on: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class TriplesMap:
    """Subject and predicate-object rules of one source.

    unique: no two rows have one subject. Then a subject's patterns are one scan; otherwise triples, which are a set,
    are deduplicated for each predicate before they are joined on the subject. push: which objects a remote source
    can filter by itself, as predicate -> URL parameter.
    """

    name: str
    source: Source
    subject: Template | Const | Ref
    objects: tuple[tuple[str, Ref | Const | Template | Parent], ...] = ()
    classes: tuple[str, ...] = ()
    unique: bool = False
    push: tuple[tuple[str, str], ...] = ()

    def pushed(self) -> dict[str, str]:
        """Column -> URL parameter, from push: the columns that the predicates' objects refer to."""
        wanted = {str(getattr(p, "value", p)): parameter for p, parameter in self.push}
        return {o.path: wanted[str(getattr(p, "value", p))] for p, o in self.objects if str(getattr(p, "value", p)) in wanted and isinstance(o, Ref)}

    def rules(self) -> list[Rule]:
        typed = [Rule(self, RDF_TYPE, Const(c)) for c in self.classes]
        return typed + [Rule(self, str(getattr(p, "value", p)), o) for p, o in self.objects]


@dataclass(frozen=True)
class Rule:
    """One subject, predicate and object."""

    map: TriplesMap
    predicate: str
    object: Ref | Const | Template | Parent

    def __hash__(self) -> int:
        return hash((self.map.name, self.predicate, self.object))


def rules_of(maps: list[TriplesMap]) -> list[Rule]:
    return [r for m in maps for r in m.rules()]
