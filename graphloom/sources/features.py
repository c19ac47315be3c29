"""Paged JSON features over HTTP as a Python data source.

    spark.dataSource.register(FeaturesSource)
    spark.read.format("features").schema("id string, geometry string, nameunit string").option("url", ...).load()

A column ``x`` is the feature's ``properties.x``, or its own member of that name (id, geometry as JSON). Equality filters
and the box reach the URL where ``push`` names their parameters, as ``column=parameter,...``; Spark keeps the filters, as a
service may ignore them. With ``limit``, pages are read by as many tasks as the service says that there are
(``numberMatched`` in its first answer, or ``total``, if it is known); otherwise one task follows the next links. A request
that fails is made ``retries`` times more; then it is an error, or an end of pages with ``on_error=empty``.

answers() makes requests for the rows of a DataFrame instead, in the tasks that hold the rows: one for each, or with
``many`` one for so many values of a column, if the service takes lists (with commas, or with what ``between`` says). URLs with the scheme
``file`` are answered from a folder that publish() has written: a features service without a server.
"""

from __future__ import annotations

import json
import os
import time
import urllib.parse
import urllib.request
import zlib
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Seconds before a failed request is made again; they double each time.
WAIT = 0.2
#: Where a published line, ``{"at":"0123abcd",...``, has its mark: the key's CRC.
_MARK = slice(7, 15)


class _Page(InputPartition):
    """A URL, and whether to follow its next links."""

    def __init__(self, url: str, follow: bool):
        super().__init__((url, follow))


def with_parameters(url: str, parameters: dict[str, object]) -> str:
    """The URL with parameters set or replaced."""
    parts = urllib.parse.urlsplit(url)
    query = dict(urllib.parse.parse_qsl(parts.query, keep_blank_values=True)) | {k: str(v) for k, v in parameters.items()}
    return urllib.parse.urlunsplit(parts._replace(query=urllib.parse.urlencode(query)))


def _lines(path: str, marks: list[bytes] | None) -> Iterator[bytes]:
    """Lines of a published file; with marks (sorted), only theirs. Lines stand in the order of their marks, so the first line
    of a mark is found by halving the file, and no more of it is read than its lines."""
    with open(path, "rb") as lines:
        if marks is None:
            yield from lines
            return
        low, end = 0, lines.seek(0, os.SEEK_END)
        for mark in marks:
            high = end
            while low < high:  # low begins a line, those before it have smaller marks; those from high on don't
                middle = (low + high) // 2
                lines.seek(max(middle - 1, 0))
                if middle:
                    lines.readline()
                at = lines.tell()
                if at < high and lines.readline()[_MARK] < mark:
                    low = lines.tell()
                else:
                    high = middle
            lines.seek(low)
            for line in lines:
                if line[_MARK] != mark:
                    break
                low += len(line)
                yield line


def _from_folder(url: str) -> dict:
    """The answer of a published folder: features equal in all parameters, from offset on, limit at most. between: what stands
    between the values of a list."""
    parts = urllib.parse.urlsplit(url)
    asked = dict(urllib.parse.parse_qsl(parts.query, keep_blank_values=True))
    at, limit = int(asked.pop("offset", 0)), asked.pop("limit", None)
    folder = urllib.parse.unquote(parts.path)
    _, key, buckets = os.path.basename(folder).rsplit("~", 2)
    between = asked.pop("between", None)
    asked = {k: set(v.split(between)) if between else {v} for k, v in asked.items()}
    wanted: dict[int, list[bytes] | None] = dict.fromkeys(range(int(buckets)))
    if key in asked:
        wanted = {}
        for crc in sorted({zlib.crc32(v.encode()) for v in asked[key]}):
            wanted.setdefault(crc % int(buckets), []).append(b"%08x" % crc)
    found = []
    for bucket, marks in sorted(wanted.items()):
        inside = f"{folder}/bucket={bucket}"
        for name in sorted(os.listdir(inside)) if os.path.isdir(inside) else ():
            if name.startswith("part-"):
                for f in map(json.loads, _lines(f"{inside}/{name}", marks)):
                    del f["at"]
                    if all(str(f.get("properties", {}).get(k)) in v for k, v in asked.items()):
                        found.append(f)
    return {"numberMatched": len(found), "features": found[at : at + int(limit) if limit else None]}


def publish(rows: DataFrame, path: str, key: str, ids: str, geometry: str | None = None, buckets: int = 64) -> str:
    """Writes rows as features below path, in buckets of the key's values and in order within these, and returns the URL that
    answers for them: a value's features are found by halving, however large the buckets are. All tasks that ask have to see
    the folder."""
    properties = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in (ids, geometry)])
    place = [F.col(f"`{geometry}`").alias("geometry")] if geometry else []
    crc = F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")), F.lit(0))
    mark = F.lower(F.lpad(F.hex(crc), 8, "0"))
    folder = f"{path.rstrip('/')}/features~{key}~{buckets}"
    made = rows.select(mark.alias("at"), F.lit("Feature").alias("type"), F.col(f"`{ids}`").cast("string").alias("id"), *place, properties.alias("properties"), (crc % buckets).alias("bucket"))
    made.repartition("bucket").sortWithinPartitions("bucket", "at").write.partitionBy("bucket").json(folder)
    return "file://" + urllib.parse.quote(folder.removeprefix("file://").removeprefix("file:"))


def fetched(url: str, options: Mapping[str, str]) -> dict | None:
    """A service's answer; None if it can't be had and ``on_error`` says ``empty``."""
    tries = 1 + int(options.get("retries", 2))
    for n in range(tries):
        try:
            if url.startswith("file:"):
                return _from_folder(url)
            with urllib.request.urlopen(url, timeout=float(options.get("timeout", 60))) as answer:
                return json.load(answer)
        except (OSError, ValueError):
            if n + 1 == tries:
                if options.get("on_error") == "empty":
                    return None
                raise
            time.sleep(WAIT * 2**n)
    return None


def pages(url: str | None, follow: bool, options: Mapping[str, str]) -> Iterator[dict]:
    """The answer at url and, if follow says so, those that its next links lead to, each once."""
    seen = set()
    while url and url not in seen:
        seen.add(url)
        page = fetched(url, options)
        if page is None:
            return
        yield page
        links = [x.get("href") for x in page.get("links", []) if x.get("rel") == "next"]
        url = urllib.parse.urljoin(url, links[0]) if follow and links else None


def cell(feature: dict, name: str, kind: str):
    """A column of a feature: its property of that name, or its own member."""
    properties = feature.get("properties") or {}
    found = properties[name] if name in properties else feature.get(name)
    if found is None:
        return None
    if kind == "string":
        return found if isinstance(found, str) else json.dumps(found, ensure_ascii=False)
    return {"long": int, "integer": int, "double": float, "float": float}.get(kind, lambda x: x)(found)


def page_urls(url: str, options: Mapping[str, str]) -> list[tuple[str, bool]]:
    """URLs that together give all features of one, and whether next links are to be followed from them."""
    limit, total = int(options.get("limit", 0)), int(options.get("total", 0))
    if not limit:
        return [(url, True)]
    if not total:
        first = fetched(with_parameters(url, {"limit": limit}), options) or {}
        total = first.get("numberMatched")
        if not isinstance(total, int):
            return [(with_parameters(url, {"limit": limit}), True)]
    return [(with_parameters(url, {"limit": limit, "offset": at}), False) for at in range(0, total, limit)]


def answers(requests: DataFrame, url: str, schema: StructType, parameters: Mapping[str, str], options: Mapping[str, str]) -> DataFrame:
    """Features that a service returns for each request: a map ``ask`` of column (or ``bbox``) -> value.

    requests also has a string ``key`` by whose hash they are dealt to tasks; each task asks for its own, one after the
    other, and keeps only what has the values asked for, as a service may ignore a parameter.
    """
    spark = requests.sparkSession
    fields = [(f.name, f.dataType.typeName()) for f in schema.fields]
    arrow, told = to_arrow_schema(schema), dict(options)
    parameters = dict(parameters)

    def together(asks: list[dict[str, str]]) -> Iterator[dict[str, list[str]]]:
        """Requests that differ in the value of one column only, as one for ``many`` values."""
        many = int(told.get("many", 1))
        groups: dict[tuple, list[str]] = {}
        for ask in asks:
            (column, value), *more = ask.items() if ask else [("", "")]  # the first is what the solutions bind
            groups.setdefault((column if column != "bbox" else f"bbox {value}", *sorted(more)), []).append(value)
        for (column, *more), values in groups.items():
            column = column.split(" ")[0]
            for at in range(0, len(values), many):
                yield ({column: values[at : at + many]} if column else {}) | {c: [v] for c, v in more}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = told.get("between", ",")
        for b in batches:
            for ask in together([dict(x) for x in b.column(0).to_pylist()]):
                own = with_parameters(url, {parameters.get(c, c): between.join(v) for c, v in ask.items()}) if ask else url
                own = with_parameters(own, {"between": between}) if url.startswith("file:") and "many" in told else own
                own = with_parameters(own, {"limit": told["limit"]}) if "limit" in told else own
                for page in pages(own, True, told):
                    found = [f for f in page.get("features", []) if all(str(cell(f, c, "string")) in v for c, v in ask.items() if c != "bbox")]
                    columns = [pa.array([cell(f, n, kind) for f in found], arrow.field(n).type) for n, kind in fields]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return requests.repartition(n, "key").select("ask").mapInArrow(run, schema)


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options, self.asked = schema, options, {}
        pairs = (p.split("=", 1) for p in options.get("push", "").split(",") if "=" in p)
        self.parameters = dict(pairs)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in self.parameters:
                self.asked[self.parameters[f.attribute[0]]] = f.value
            yield f  # Spark checks again

    def partitions(self) -> list[InputPartition]:
        asked = dict(self.asked)
        if box := self.options.get("bbox"):
            asked["bbox"] = box
        url = with_parameters(self.options["url"], asked) if asked else self.options["url"]
        return [_Page(*page) for page in page_urls(url, self.options)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        kinds = [(f.name, f.dataType.typeName()) for f in self.schema.fields]
        for page in pages(*partition.value, self.options):
            for feature in page.get("features", []):
                yield tuple(cell(feature, *kind) for kind in kinds)


class FeaturesSource(DataSource):
    """The format ``features``."""

    @classmethod
    def name(cls) -> str:
        return "features"

    def schema(self) -> str:
        return "id string, geometry string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


class _CollectionsReader(DataSourceReader):
    """Two levels: the service's list of collections, then the pages of each, as many as it says that there are."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        base = self.options["url"].rstrip("/")
        told = fetched(base + "/collections?f=json", self.options) or {}
        chosen = set(filter(None, self.options.get("select", "").split(",")))
        found = [c for c in told.get("collections", []) if not chosen or c["id"] in chosen]
        if self.options.get("items") != "true":
            return [InputPartition(("list", c)) for c in found]
        parts = []
        for c in found:
            url = f"{base}/collections/{urllib.parse.quote(c['id'])}/items?f=json"
            parts += [InputPartition((c["id"], page)) for page in page_urls(url, {"limit": "1000"} | self.options)]
        return parts

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        name, what = partition.value
        kinds = [(f.name, f.dataType.typeName()) for f in self.schema.fields]
        if name == "list":
            about = what | {"title": what.get("title", what["id"]), "spatial": (what.get("extent") or {}).get("spatial")}
            yield tuple(cell(about, *kind) for kind in kinds)
            return
        for page in pages(*what, self.options):
            for feature in page.get("features", []):
                yield tuple(name if n == "collection" else cell(feature, n, kind) for n, kind in kinds)


class CollectionsSource(DataSource):
    """The format ``collections``: a features service's collections (id, title, description, spatial), or with ``items=true``
    the features of all of them with the name of their ``collection``. select: ids, with commas between."""

    @classmethod
    def name(cls) -> str:
        return "collections"

    def schema(self) -> str:
        items = self.options.get("items") == "true"
        return "collection string, id string, geometry string" if items else "id string, title string, description string, spatial string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _CollectionsReader(schema, dict(self.options))
