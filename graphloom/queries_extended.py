"""More queries that show one operator each: exact relations of general shapes, long paths, services asked by solutions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.annotate import discover, generate
from graphloom.functions import validation
from graphloom.functions.terms import GEO, XSD, Const, Ref, Template
from graphloom.operators import runs, vectors
from graphloom.operators.durable import shared
from graphloom.operators.solutions import Solutions
from graphloom.operators.spatial import spatial_join
from graphloom.plans.graph import VirtualGraph
from graphloom.plans.paths import Plus
from graphloom.queries import _COSINE, EX, query
from graphloom.sinks import results
from graphloom.sources.features import publish
from graphloom.sources.mapping import Source, TriplesMap

# ---- exact relations between shapes that are no boxes


#: Places and sizes of a table's keys. Diamonds around them are boxes in u = x + y and v = x - y, which is how SQL sees them.
_AT = "(SELECT {key} AS k, {key} % 90 AS x, {key} * 7 % 80 AS y, 2 + {key} % 4 AS r, {key} % 90 + {key} * 7 % 80 AS u, {key} % 90 - {key} * 7 % 80 AS v FROM {table})"
_S, _C = _AT.replace("{key}", "s_suppkey").replace("{table}", "supplier"), _AT.replace("{key}", "c_custkey").replace("{table}", "customer")


def _places(spark: SparkSession, sf: str, table: str, key: str) -> DataFrame:
    k = F.col(key)
    return spark.read.parquet(f"{sf}/{table}.parquet").select(k.alias("k"), (k % 90).alias("x"), (k * 7 % 80).alias("y"), (2 + k % 4).alias("r"))


def _corners(radius) -> F.Column:
    """A diamond's ring around (x, y)."""
    x, y = F.col("x"), F.col("y")
    points = [(x + radius, y), (x, y + radius), (x - radius, y), (x, y - radius), (x + radius, y)]
    return F.concat(F.lit("("), F.array_join(F.array(*[F.concat_ws(" ", p, q) for p, q in points]), ", "), F.lit(")"))


def _stroke(up) -> F.Column:
    """A line through (x, y), up or down to the right: mirror images of one another."""
    x, y, turn = F.col("x"), F.col("y"), F.when(up, 3).otherwise(-3)
    return F.concat(F.lit("LINESTRING("), x - 3, F.lit(" "), y - turn, F.lit(", "), x, F.lit(" "), y, F.lit(", "), x + 3, F.lit(" "), y + turn, F.lit(")"))


def _related(spark: SparkSession, sf: str, one, two, predicate: str) -> DataFrame:
    """Keys of suppliers and customers whose shapes fulfil the predicate."""
    left = Solutions.of(_places(spark, sf, "supplier", "s_suppkey").select(F.col("k").alias("s"), one.alias("g")))
    right = Solutions.of(_places(spark, sf, "customer", "c_custkey").select(F.col("k").alias("c"), two.alias("h")))
    return spatial_join(left, right, "g", "h", predicate, smallest=8.0).select("s", "c").frame()


@query(f"SELECT a.k AS s, b.k AS c FROM {_S} a, {_C} b WHERE a.k % 2 <> b.k % 2 AND abs(a.u - b.u) < 6 AND abs(a.v - b.v) < 6")
def spatial_lines_cross(spark, sf):
    """Lines against lines: mirror images share their bounds, length and centroid, and only unlike ones cross."""
    return _related(spark, sf, _stroke(F.col("k") % 2 == 0), _stroke(F.col("k") % 2 == 0), "crosses")


_INSIDE = "abs(a.u - b.u) <= {p}.r - {q}.r AND abs(a.v - b.v) <= {p}.r - {q}.r"


@query(f"SELECT a.k AS s, b.k AS c FROM {_S} a, {_C} b WHERE abs(a.u - b.u) < a.r + b.r AND abs(a.v - b.v) < a.r + b.r AND NOT ({_INSIDE.format(p='a', q='b')}) AND NOT ({_INSIDE.format(p='b', q='a')})")
def spatial_areas_overlap(spark, sf):
    diamond = F.concat(F.lit("POLYGON("), _corners(F.col("r")), F.lit(")"))
    return _related(spark, sf, diamond, diamond, "overlaps")


@query(f"SELECT a.k AS s, b.k AS c FROM {_S} a, {_C} b WHERE abs(a.v - b.v) < b.r AND abs(a.u - b.u) < 6 + b.r AND NOT abs(a.u - b.u) <= b.r - 6")
def spatial_line_area(spark, sf):
    """Lines that cross areas: some of a line is inside, some is not."""
    return _related(spark, sf, _stroke(F.lit(True)), F.concat(F.lit("POLYGON("), _corners(F.col("r") + 0), F.lit(")")), "crosses")


@query(f"SELECT a.k AS s, b.k AS c FROM {_S} a, {_C} b WHERE abs(a.u - b.u) <= 9 - a.r AND abs(a.v - b.v) <= 9 - a.r AND (abs(a.u - b.u) >= 3 + a.r OR abs(a.v - b.v) >= 3 + a.r)")
def spatial_holes(spark, sf):
    """Areas within areas that have a hole."""
    diamond = F.concat(F.lit("POLYGON("), _corners(F.col("r")), F.lit(")"))
    ring = F.concat(F.lit("POLYGON("), _corners(F.lit(9)), F.lit(", "), _corners(F.lit(3)), F.lit(")"))
    return _related(spark, sf, diamond, ring, "within")


# ---- long paths


@query("SELECT 'http://ex/step/' || p_partkey AS x FROM part WHERE p_partkey > 1 AND p_partkey % 2 = 1")
def path_long_chain(spark, sf):
    """A path of as many steps as every second part: found in as many rounds as that number has binary digits."""
    rows = Source.sql("step", "SELECT p_partkey AS a, p_partkey + 2 AS b FROM {part} WHERE p_partkey + 2 <= (SELECT max(p_partkey) FROM {part})", {"part": f"{sf}/part.parquet"})
    g = VirtualGraph(spark, [TriplesMap("step", rows, Template("http://ex/step/{a}"), ((EX.next, Template("http://ex/step/{b}")),), unique=True)])
    return g.match((EX["step/1"], Plus(EX.next), "?x")).frame()


# ---- services that executors ask


@query("SELECT 'http://ex/customer/' || c_custkey AS c, 'http://ex/served/' || o_orderkey AS o, o_totalprice AS total FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0 AND c_mktsegment = 'BUILDING'")
def dependent_service(spark, sf):
    """A dependent join: the orders' service, a folder of published pages, is asked for the customers that are left."""
    g = _served(spark, sf)
    return g.match(("?c", EX.segment, "BUILDING"), ("?c", EX.balance, "?b"), ("?c", EX.key, "?k"), ("?o", EX.by, "?k"), ("?o", EX.total, "?total")).filter(F.col("b") < 0).select("c", "o", "total").frame()


def _served(spark: SparkSession, sf: str) -> VirtualGraph:
    integer, double = XSD + "integer", XSD + "double"
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    url = publish(orders, f"{shared(spark)}/service-{uuid.uuid4().hex}", "o_custkey", "o_orderkey")
    served = TriplesMap("served", Source.features("served", url, "o_orderkey long, o_custkey long, o_totalprice double, id string", many="20"), Template("http://ex/served/{id}"), ((EX.by, Ref("o_custkey", integer)), (EX.total, Ref("o_totalprice", double))), (), True, ((EX.by, "o_custkey"),))
    rows = Source.sql("indebted", "SELECT * FROM {customer} WHERE c_acctbal < 0", {"customer": f"{sf}/customer.parquet"})
    own = TriplesMap("customer", rows, Template("http://ex/customer/{c_custkey}"), ((EX.segment, Ref("c_mktsegment")), (EX.balance, Ref("c_acctbal", double)), (EX.key, Ref("c_custkey", integer))), (), True)
    return VirtualGraph(spark, [own, served])


# ---- selection of rules by complete chains


@query("SELECT 'http://ex/customer/' || c_custkey AS c, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal < 0")
def chain_selection(spark, sf):
    """A chain of three stars. Rules that agree with a neighbour each, but stand in no complete chain, aren't scanned: were they,
    a part's maker or a clerk's office would have to be read."""
    table = lambda n: Source.parquet(n, f"{sf}/{n}.parquet")
    made = [
        TriplesMap("customer", Source.sql("poor", "SELECT * FROM {customer} WHERE c_acctbal < 0", {"customer": f"{sf}/customer.parquet"}), Template("http://ex/customer/{c_custkey}"), ((EX["in"], Template("http://ex/nation/{c_nationkey}")),), (), True),
        TriplesMap("nation", table("nation"), Template("http://ex/nation/{n_nationkey}"), ((EX["in"], Template("http://ex/region/{n_regionkey}")), (EX.name, Ref("n_name"))), (), True),
        TriplesMap("region", table("region"), Template("http://ex/region/{r_regionkey}"), ((EX.name, Ref("r_name")),), (), True),
        TriplesMap("clerk", table("orders"), Template("http://ex/clerk/{o_orderkey}"), ((EX["in"], Template("http://ex/office/{o_clerk}")),), (), False),
    ]
    found = VirtualGraph(spark, made).match(("?c", EX["in"], "?n"), ("?n", EX["in"], "?r"), ("?n", EX.name, "?nation"), ("?r", EX.name, "?region"))
    return found.select("c", "nation", "region").frame()


# ---- JSON against a schema, features and triples as texts


_KS = ", ".join(map(str, range(50)))


@query(f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN CASE WHEN CAST(json_extract(props, '$.k') AS INT) >= 50 THEN '$.k must be one of: {_KS}.' END WHEN 1 THEN '$ is missing required field(s): k.'
  WHEN 2 THEN '$[0].k must be one of: {_KS}.' ELSE '$ is no JSON.' END AS fault, CASE event_id % 4 WHEN 0 THEN CASE WHEN CAST(json_extract(props, '$.k') AS INT) >= 50 THEN '$.k' END WHEN 2 THEN '$[0].k' ELSE '$' END AS path
FROM events WHERE event_id % 4 <> 2 OR CAST(json_extract(props, '$.k') AS INT) >= 50""")
def json_faults(spark, sf):
    """Texts against a schema: sound ones, wrong values, fields that are missing, lists of objects, and what is no JSON."""
    one = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"enum": list(range(50))}}}
    events = spark.read.parquet(f"{sf}/events.parquet")
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.col("props")).when(kind == 1, F.lit("{}")).when(kind == 2, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.concat(F.lit("{"), "props"))
    value = events.select("event_id", F.try_parse_json(text).alias("v"))
    listed = value.filter(F.col("event_id") % 4 == 2).select("event_id", validation.fault(F.col("v"), {"type": "array", "items": one}).alias("fault")).filter("fault IS NOT NULL")
    plain = value.filter(F.col("event_id") % 4 != 2).select("event_id", validation.fault(F.col("v"), one).alias("fault"))
    return plain.union(listed).withColumn("path", validation.fault_path(F.col("fault")))


@query("""SELECT '{"type":"Feature","id":"http://ex/at/' || s_suppkey || '","geometry":{"type":"Point","coordinates":[' || s_suppkey % 90 || '.0,' || s_suppkey * 7 % 80 || '.0]},"properties":{"balance":["' || (s_nationkey + 100) || '","' || (s_nationkey + 200) || '"],"title":"' || s_name || '","label":"' || s_name || '"}}' AS feature FROM supplier""")
def features_geojson(spark, sf):
    """Features as GeoJSON: the geometry is an object, a property of one value is no list."""
    rows = Source.sql("at", "SELECT s_suppkey, s_name, array(s_nationkey + 100, s_nationkey + 200) AS both, concat('POINT(', s_suppkey % 90, ' ', s_suppkey * 7 % 80, ')') AS wkt FROM {supplier}", {"supplier": f"{sf}/supplier.parquet"})
    at = TriplesMap("at", rows, Template("http://ex/at/{s_suppkey}"), ((Const(GEO + "hasGeometry"), Ref("wkt", GEO + "wktLiteral")), (EX.title, Ref("s_name")), (EX.balance, Ref("both[*]", XSD + "integer"))), (), True)
    return results.feature_json(results.features(VirtualGraph(spark, [at]).triples()))


@query("SELECT doc_id, text, strlen(text) AS bytes FROM documents")
def ntriples_round_trip(spark, sf):
    """Texts with line breaks, quotes and backslashes as N-Triples lines, and read again."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    triples = docs.select(F.concat(F.lit("http://ex/doc/"), "doc_id").alias("s"), F.lit("http://ex/text").alias("p"), F.col("text").alias("o"))
    again = generate.read_ntriples(generate.turtle(triples).withColumnRenamed("line", "value"))
    return again.select(F.element_at(F.split("s.value", "/"), -1).cast("long").alias("doc_id"), F.col("o.value").alias("text"), F.octet_length("o.value").cast("long").alias("bytes"))


# ---- ontologies


def _told(spark: SparkSession, sf: str) -> DataFrame:
    """Triples about a class for each region and a property for each nation: of its region, or of that one and the next by a list."""
    ex, list_ = "http://ex/", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    regions, nations = spark.read.parquet(f"{sf}/region.parquet"), spark.read.parquet(f"{sf}/nation.parquet")
    cls = lambda k: F.concat(F.lit(ex + "region_"), k)
    prop, key, region = F.concat(F.lit(ex + "p"), "n_nationkey"), F.col("n_nationkey").cast("string"), F.col("n_regionkey")
    node = lambda i: F.concat(F.lit(f"_:l{i}_"), key)
    row = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    union = [row(prop, discover.RDFS + "domain", F.concat(F.lit("_:u"), key)), row(F.concat(F.lit("_:u"), key), discover.OWL + "unionOf", node(0)), row(node(0), list_ + "first", cls(region)), row(node(0), list_ + "rest", node(1))]
    union += [row(node(1), list_ + "first", cls((region + 1) % 5)), row(node(1), list_ + "rest", F.lit(list_ + "nil"))]
    both = [row(prop, list_ + "type", F.lit(list_ + "Property")), row(prop, discover.RDFS + "range", F.concat(F.lit(XSD), F.when(F.col("n_nationkey") % 3 == 0, "float").otherwise("date")))]
    told = nations.select(F.explode(F.when(F.col("n_nationkey") % 2 == 0, F.array(*both, *union)).otherwise(F.array(*both, row(prop, discover.RDFS + "domain", cls(region))))).alias("t")).select("t.*")
    classes = regions.select(F.explode(F.array(*[F.struct(cls(F.col("r_regionkey")).alias("s"), F.lit(p).alias("p"), o.alias("o")) for p, o in ((discover.RDFS + "subClassOf", F.lit(GEO + "Feature")), (discover.RDFS + "label", F.col("r_name")), (list_ + "type", F.lit(discover.OWL + "Class")))])).alias("t"))
    return told.union(classes.select("t.*"))


_IN = "(SELECT n_nationkey, n_regionkey AS r FROM nation UNION SELECT n_nationkey, (n_regionkey + 1) % 5 FROM nation WHERE n_nationkey % 2 = 0)"


@query(f"SELECT 'http://ex/region_' || r_regionkey AS cls, r_name AS title, 'http://ex/p' || n_nationkey AS property, CASE WHEN n_nationkey % 3 = 0 THEN 'number' ELSE 'date' END AS type FROM region JOIN {_IN} ON r = r_regionkey")
def discovered_collections(spark, sf):
    """Classes and their properties from an ontology whose domains are classes, or unions of them as lists."""
    return discover.collections(_told(spark, sf), "http://ex/").select("cls", "title", "property", "type")


@query("SELECT 'http://ex/region_' || r_regionkey AS iri, 'Class: region_' || r_regionkey || '. Label: ' || r_name || '. Description: .' AS text FROM region")
def entity_texts(spark, sf):
    return discover.entity_texts(_told(spark, sf)).select("iri", "text")


@query(f"SELECT 'http://ex/region_' || r_regionkey AS cls, count(*) AS properties, count(*) FILTER (n_nationkey < 9) AS aligned, min('http://ex/p' || n_nationkey) AS first FROM region JOIN {_IN} ON r = r_regionkey GROUP BY ALL")
def class_reports(spark, sf):
    """A document for each class, with its properties' decisions."""
    nations = spark.read.parquet(f"{sf}/nation.parquet").filter("n_nationkey < 9")
    chosen = nations.select(F.concat(F.lit("http://ex/p"), "n_nationkey").alias("local"), F.concat(F.lit("http://s/"), "n_name").alias("accepted"), F.lit("local").alias("source"))
    told = _told(spark, sf)
    made = discover.report(discover.collections(told, "http://ex/"), chosen)
    at = lambda path: F.get_json_object("report", path)
    return made.select("cls", at("$.statistics.properties").cast("long").alias("properties"), at("$.statistics.aligned").cast("long").alias("aligned"), at("$.properties[0].property").alias("first"))


# ---- vectors, runs


@query(f"SELECT term, entity, score, CAST(r AS INT) AS rank FROM (SELECT q.vec_id AS term, e.vec_id AS entity, {_COSINE} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE} DESC, e.vec_id) AS r FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0) WHERE r <= 3")
def vector_stored_index(spark, sf):
    """Nearest entities by a stored index: built once, then read."""
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    path = f"{shared(spark)}/index-{uuid.uuid4().hex}"
    index = vectors.stored_index(table.withColumnRenamed("vec_id", "entity"), path)
    return vectors.nearest_in(index, table.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "term"), k=3, threshold=-2.0)


@query("SELECT event_id % 40 AS query_id, max(event_id) FILTER (event_type <> 'error') AS execution_order, 'success' AS status FROM events GROUP BY ALL HAVING max(event_id) FILTER (event_type <> 'error') IS NOT NULL")
def resumed_runs(spark, sf):
    """A log that is resumed: of each query the last successful run stays, once."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    status = F.when(F.col("event_type") == "error", "failed").otherwise("success")
    rows = events.select((F.col("event_id") % 40).alias("query_id"), F.col("event_id").alias("execution_order"), status.alias("status"))
    log = runs.RunLog(spark, f"{shared(spark)}/runs-{uuid.uuid4().hex}", "query_id long, execution_order long, status string")
    log.append(rows)
    log.append(rows.filter("execution_order % 3 = 0"))  # what a crashed run wrote again
    return log.resume(["query_id"])
