"""Queries that show one operator each, where those of ``queries`` use it only beside others."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.annotate import align, generate
from graphloom.functions import geodesy, scalars
from graphloom.functions import geometry as geo
from graphloom.functions.terms import GEO, XSD, Const, Ref, Template, TermType
from graphloom.operators import runs, vectors
from graphloom.operators.solutions import Solutions
from graphloom.operators.spatial import in_box
from graphloom.plans.graph import VirtualGraph
from graphloom.plans.paths import Maybe, Plus, Star
from graphloom.queries import _COSINE, _GRID, _POINT, _SQUARE, EX, TYPE, _boxes, _json_graph, _nested, _place, _round, graph, query
from graphloom.sinks import results
from graphloom.sources.mapping import Source, TriplesMap

# ---- patterns, joins, paths


@query("SELECT 'http://ex/event/' || event_id AS e, 'http://ex/supplier/' || s_suppkey AS s, user_id AS n FROM events JOIN supplier ON user_id = s_nationkey WHERE event_type = 'click'")
def literal_value_join(spark, sf):
    """Two stars that share a literal."""
    found = graph(spark, sf, "event supplier").match(("?e", EX.kind, "click"), ("?e", EX.user, "?n"), ("?s", TYPE, EX.Supplier), ("?s", EX.supplierNation, "?n"))
    return found.select("e", "s", "n").frame()


@query("SELECT n_name AS nation, r_name AS region FROM nation CROSS JOIN region")
def cross_join(spark, sf):
    g = graph(spark, sf, "nation region")
    return g.match(("?n", TYPE, EX.Nation), ("?n", EX.name, "?nation")).join(g.match(("?r", TYPE, EX.Region), ("?r", EX.name, "?region"))).select("nation", "region").frame()


@query("SELECT 'http://ex/pair/' || user_id || '/' || event_id % 5 AS p, event_id % 5 AS x FROM events WHERE user_id = event_id % 5 GROUP BY ALL")
def repeated_variable(spark, sf):
    """A variable that a pattern has twice."""
    rows = Source.frame("pair", lambda s: s.read.parquet(f"{sf}/events.parquet").select("user_id", (F.col("event_id") % 5).alias("five")))
    g = VirtualGraph(spark, [TriplesMap("pair", rows, Template("http://ex/pair/{user_id}/{five}"), ((EX.user, Ref("user_id", XSD + "integer")), (EX.five, Ref("five", XSD + "integer"))))])
    return g.match(("?p", EX.user, "?x"), ("?p", EX.five, "?x")).frame()


@query("SELECT 'http://ex/customer/' || c_custkey AS c, c_name AS name, c_mktsegment AS segment FROM customer")
def star_selection(spark, sf):
    """Rules chosen by the coarser way, for stars: the same solutions."""
    return graph(spark, sf, select="star").match(("?c", TYPE, EX.Customer), ("?c", EX.name, "?name"), ("?c", EX.segment, "?segment")).frame()


@query("SELECT 'http://ex/order/' || o_orderkey AS o, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT'")
def seeded_order(spark, sf):
    """Stars in random order from a seed: the same solutions."""
    g = graph(spark, sf, order="random", seed=7)
    return g.match(("?n", EX.name, "?nation"), ("?c", EX.nation, "?n"), ("?o", EX.customer, "?c"), ("?o", EX.priority, "1-URGENT")).select("o", "nation").frame()


@query("SELECT 'http://ex/region/' || n_regionkey AS y FROM nation WHERE n_nationkey = 7 UNION SELECT 'http://ex/nation/7'")
def path_bound_start(spark, sf):
    """A path from one node: the frontier grows from it alone."""
    return graph(spark, sf, "nation region").match((EX["nation/7"], Star(EX.partOf), "?y")).frame()


@query("SELECT 'http://ex/nation/' || n_nationkey AS x FROM nation WHERE n_regionkey = 2")
def path_bound_end(spark, sf):
    return graph(spark, sf, "nation region").match(("?x", Plus(EX.partOf), EX["region/2"])).frame()


@query("SELECT 'http://ex/nowhere' AS y")
def path_no_step(spark, sf):
    """A path of no step leads from any node to itself, even from one that the graph doesn't have."""
    return graph(spark, sf, "nation").match((EX.nowhere, Star(EX.partOf), "?y")).frame()


@query("""SELECT 'http://ex/nation/' || n_nationkey AS x, 'http://ex/region/' || n_regionkey AS y FROM nation UNION SELECT 'http://ex/nation/' || n_nationkey, 'http://ex/nation/' || n_nationkey FROM nation
UNION SELECT 'http://ex/region/' || n_regionkey, 'http://ex/region/' || n_regionkey FROM nation UNION SELECT 'http://ex/Nation', 'http://ex/Nation'""")
def path_optional(spark, sf):
    return graph(spark, sf, "nation").match(("?x", Maybe(EX.partOf), "?y")).frame()


@query("SELECT 'http://ex/doc/' || d.doc_id AS d, quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE EXISTS (SELECT 1 FROM labels m WHERE m.doc_id = d.doc_id AND (quality IS NULL OR m.quality = quality) AND m.toxic = 0)")
def exists_unbound(spark, sf):
    """Perhaps unbound variables are compatible with anything in EXISTS, too."""
    g = graph(spark, sf, "document label")
    left = g.match(("?d", EX.lang, "?lang")).optional(g.match(("?d", EX.quality, "?quality")))
    return left.exists(g.match(("?d", EX.quality, "?quality"), ("?d", EX.toxic, 0))).select("d", "quality").frame()


@query("SELECT 'http://ex/doc/' || doc_id AS d, quality, CASE WHEN n_chars > 1000 THEN toxic END AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def optional_condition_unbound(spark, sf):
    """A condition on an OPTIONAL whose shared variables may be unbound."""
    g = graph(spark, sf, "document label")
    left = g.match(("?d", EX.chars, "?chars")).optional(g.match(("?d", EX.quality, "?quality")))
    return left.optional(g.match(("?d", EX.quality, "?quality"), ("?d", EX.toxic, "?toxic")), F.col("chars") > 1000).select("d", "quality", "toxic").frame()


# ---- nested sources


@query("SELECT DISTINCT 'http://ex/value/' || l_linenumber || '/' || CAST(l_quantity AS BIGINT) AS v, l_quantity AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def json_iterator(spark, sf):
    """Rows are the elements of a nested array."""
    rows = Source.frame("values", lambda s: _nested(s, sf).select("COD", F.transform("Data", lambda d: F.struct(d["No"].alias("No"), d["Valor"].alias("Valor"), d["Valor"].cast("long").alias("whole"))).alias("Data")), "$.Data[*]")
    g = VirtualGraph(spark, [TriplesMap("values", rows, Template("http://ex/value/{No}/{whole}"), ((EX.quantity, Ref("Valor", XSD + "double")),))])
    return g.match(("?v", EX.quantity, "?quantity")).frame()


@query("SELECT DISTINCT o_orderpriority AS name FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) UNION SELECT o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def json_any_depth(spark, sf):
    """An iterator that reaches a field at any depth."""
    rows = Source.frame("facts", lambda s: _nested(s, sf).select("COD", F.struct("MetaData").alias("about")), "$..MetaData[*]")
    g = VirtualGraph(spark, [TriplesMap("facts", rows, Template("http://ex/fact/{Variable.Id}"), ((EX.name, Ref("Nombre")),))])
    return g.match(("?f", EX.name, "?name")).select("name").distinct().frame()


@query("SELECT DISTINCT 'http://ex/item/' || l_orderkey || '_' || l_linenumber AS i, 'http://ex/series/' || l_orderkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def json_parent_same_source(spark, sf):
    """A referencing object of the same rows."""
    return _json_graph(spark, sf).match(("?i", EX.series, "?s")).frame()


# ---- space


@query(f"SELECT 'http://ex/vec/' || vec_id AS p, round(px, 6) AS x, round(py, 6) AS y FROM {_POINT} WHERE px >= -5 AND py >= -5 AND px <= 12 AND py <= 12")
def viewport(spark, sf):
    """Points in a box, by their numbers: the condition reaches the scan."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.concat(F.lit("http://ex/vec/"), "vec_id").alias("p"), (F.col("embedding")[0].cast("double") * 100).alias("x"), (F.col("embedding")[1].cast("double") * 100).alias("y"))
    return in_box(Solutions.of(rows), "x", "y", (-5, -5, 12, 12)).frame().withColumns({"x": _round("x", 6), "y": _round("y", 6)})


@query("SELECT box_id, x <= -5 AND y <= -5 AND x + 10 >= -3 AND y + 10 >= -3 AS holds, (CASE WHEN greatest(x, -5.0) < least(x + 10, 12.0) AND greatest(y, -5.0) < least(y + 10, 12.0) THEN 100 - (least(x + 10, 12.0) - greatest(x, -5.0)) * (least(y + 10, 12.0) - greatest(y, -5.0)) ELSE 100 END) AS rest FROM " + _GRID)
def bbox_rest(spark, sf):
    """Which boxes hold a small one, and the area that is left of each without a window."""
    small, window = (geo.bbox_parse(F.lit(t)) for t in ("-5,-5,-3,-3", "-5,-5,12,12"))
    rest = F.aggregate(geo.bbox_subtract(F.col("box"), window), F.lit(0.0), lambda s, b: s + (b["xmax"] - b["xmin"]) * (b["ymax"] - b["ymin"]))
    return _boxes(spark, sf).select("box_id", geo.bbox_contains(F.col("box"), small).alias("holds"), rest.alias("rest"))


@query(f"SELECT label, max(px) AS xmin, max(py) AS ymin, min(px + 60) AS xmax, min(py + 60) AS ymax FROM {_SQUARE} JOIN embeddings USING (vec_id) GROUP BY ALL HAVING max(px) <= min(px + 60) AND max(py) <= min(py + 60)")
def common_box(spark, sf):
    """The box that all boxes of a group share."""
    corner = lambda i: F.round(F.col("embedding")[i].cast("double") * 100, 3)
    box = F.struct(corner(0).alias("xmin"), corner(1).alias("ymin"), (corner(0) + 60).alias("xmax"), (corner(1) + 60).alias("ymax"))
    found = spark.read.parquet(f"{sf}/embeddings.parquet").groupBy("label").agg(geo.common_extent(box).alias("b")).filter("b IS NOT NULL")
    return found.select("label", "b.*")


@query("SELECT box_id, 'POLYGON((' || x || ' ' || y || ', ' || (x + 10) || ' ' || y || ', ' || (x + 10) || ' ' || (y + 10) || ', ' || x || ' ' || (y + 10) || ', ' || x || ' ' || y || '))' AS wkt, x + 5 AS cx, y + 5 AS cy FROM " + _GRID)
def box_polygons(spark, sf):
    """Boxes as polygons, and the polygons' centroids."""
    g = geo.geometry("wkt")
    return _boxes(spark, sf).select("box_id", "wkt", F.round(g["cx"], 6).alias("cx"), F.round(g["cy"], 6).alias("cy"))


_W = "(1 - {e} * pow(sin(radians({lat})), 2))".replace("{e}", "(2 - 1 / 298.257223563) / 298.257223563")
_FLAT = "0.0"
_DY = f"degrees(100000 / (6378137.0 * (1 - (2 - 1 / 298.257223563) / 298.257223563) / pow({_W.replace('{lat}', _FLAT)}, 1.5)))"
_LAT = f"(greatest(abs(y), abs(y + 10)) + {_DY})"
_DX = f"degrees(100000 / (6378137.0 / sqrt({_W.replace('{lat}', _LAT)}) * cos(radians({_LAT}))))"


@query(f"SELECT box_id, round(x - {_DX} * 1.000001, 3) AS xmin, round(y - {_DY} * 1.000001, 3) AS ymin, round(x + 10 + {_DX} * 1.000001, 3) AS xmax, round(y + 10 + {_DY} * 1.000001, 3) AS ymax FROM {_GRID}")
def buffered_boxes(spark, sf):
    """Boxes widened by 100 km, enough at each of their latitudes."""
    wide = geodesy.buffered(F.col("box"), F.lit(100_000.0))
    return _boxes(spark, sf).select("box_id", *[F.round(wide[c], 3).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query("SELECT 'http://ex/box/' || box_id AS b, true AS meets FROM " + _GRID + " WHERE x <= -3 AND x + 10 >= -5 AND y <= -3 AND y + 10 >= -5")
def functions_by_iri(spark, sf):
    """A spatial function looked up by its IRI, in a filter with a constant geometry."""
    meets = scalars.function("http://www.opengis.net/def/function/geosparql/sfIntersects")
    found = graph(spark, sf, "box").match(("?b", Const(GEO + "hasGeometry"), "?g")).bind("meets", meets(F.col("g"), F.lit("POLYGON((-5 -5, -3 -5, -3 -3, -5 -3, -5 -5))")))
    return found.filter(F.col("meets")).select("b", "meets").frame()


# ---- vectors


@query(f"SELECT term, entity, score FROM (SELECT q.vec_id AS term, e.vec_id AS entity, {_COSINE} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE} DESC, e.vec_id) AS r FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND e.vec_id % 100 <> 0) WHERE r = 1")
def vector_nearest(spark, sf):
    """The nearest entity of each term, of those that aren't terms."""
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    terms, entities = table.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "term"), table.filter("vec_id % 100 <> 0").withColumnRenamed("vec_id", "entity")
    return vectors.nearest(terms, entities, k=1, threshold=-2.0).drop("rank")


# ---- scalar functions


@query("SELECT 'http://ex/order/' || o_orderkey AS o, CAST(second(o_orderdate) + 0.25 AS DOUBLE) AS s, 'PT5H30M' AS zone, '-08:00' AS tz FROM orders")
def seconds_and_zones(spark, sf):
    found = graph(spark, sf, "orders").match(("?o", EX.date, "?date"))
    moment = F.col("date") + F.expr("INTERVAL 0.25 SECOND")
    text = F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss")
    found = found.bind("s", scalars.function("seconds")(moment).cast("double")).bind("zone", scalars.function("timezone")(F.concat(text, F.lit("+05:30")))).bind("tz", scalars.function("tz")(F.concat(text, F.lit("-08:00"))))
    return found.select("o", "s", "zone", "tz").frame()


@query("SELECT 'http://ex/n/' || n_name AS i, n_name AS v, 'http://ex/own' AS datatype, 'en' AS lang, 'bnode' AS kind, true AS urn FROM nation")
def term_builders(spark, sf):
    found = graph(spark, sf, "nation").match(("?n", EX.name, "?name"))
    name, f = F.col("name"), scalars.function
    made = {"i": f("IRI")(name, "http://ex/n/")["value"], "v": f("STRDT")(name, F.lit("http://ex/own"))["value"], "datatype": f("STRDT")(name, F.lit("http://ex/own"))["datatype"], "lang": f("STRLANG")(name, F.lit("EN"))["lang"], "kind": f("BNODE")(name)["kind"], "urn": f("UUID")().rlike("^urn:uuid:[0-9a-f-]{36}$")}
    for n, column in made.items():
        found = found.bind(n, column)
    return found.select(*made).frame()


@query("SELECT 'http://ex/part/' || p_partkey AS p, p_size - 10 <> 0 AS number, length(substr(p_name, 1, p_size % 3)) > 0 AS text FROM part")
def truth_values(spark, sf):
    """Effective boolean values of numbers and strings."""
    found = graph(spark, sf, "part").match(("?p", TYPE, EX.Part), ("?p", EX.size, "?size"), ("?p", EX.name, "?name"))
    number, text = scalars.truth(F.col("size") - 10, TermType("literal", XSD + "integer")), scalars.truth(F.substring(F.col("name"), F.lit(1), F.col("size") % 3), TermType("literal"))
    return found.bind("number", number).bind("text", text).select("p", "number", "text").frame()


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS bytes, 0 AS spatial_functions FROM documents")
def query_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", scalars.query_metadata(F.col("text")).alias("m"))
    return docs.select("doc_id", "m.*")


@query("SELECT page_id, regexp_extract(rtrim(url_decode(url), '/#'), '[^/#]+$') AS shown, url AS literal FROM pages")
def compact_values(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", scalars.compact(F.lit("uri"), F.col("url")).alias("shown"), scalars.compact(F.lit("literal"), F.col("url")).alias("literal"))


# ---- runs and results


@query("SELECT event_type, count(*) AS calls, count(*) FILTER (event_id % 7 <> 0) AS calls_ok, count(*) FILTER (event_id % 7 = 0) AS calls_failed, sum(event_id) AS bytes, round(sum(value), 4) AS seconds FROM events GROUP BY ALL")
def call_totals(spark, sf):
    calls = spark.read.parquet(f"{sf}/events.parquet").select("event_type", F.when(F.col("event_id") % 7 == 0, 500).otherwise(200).alias("status_code"), F.col("event_id").alias("bytes"), F.col("value").alias("seconds"))
    return runs.call_totals(calls, ["event_type"]).withColumn("seconds", _round("seconds"))


@query("SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS call_index FROM events")
def call_index(spark, sf):
    return runs.numbered(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


#: Twelve hexadecimal digits of a row's digest as a number, summed.
_PART = "sum(CAST('0x' || substr(h, {at}, 12) AS UBIGINT))"


@query("WITH r AS (SELECT sha256('event_id=' || event_id || chr(9) || 'user_id=' || user_id || chr(9) || 'event_type=' || event_type) AS h FROM events) SELECT count(*) AS result_rows, sha256(count(*) || ':' || " + " || ':' || ".join(_PART.replace("{at}", str(at)) for at in (1, 13, 25)) + ") AS result_hash FROM r")
def row_digest(spark, sf):
    """A digest of a bag of rows: sums of the rows' digests, so nothing is gathered or sorted."""
    return results.digest(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type"))


# ---- ontologies, mappings, alignment


@query("SELECT 'http://ex/' || column_name AS property, column_name AS path, CASE column_name WHEN 'c_custkey' THEN 'http://www.w3.org/2001/XMLSchema#long' WHEN 'c_nationkey' THEN 'http://www.w3.org/2001/XMLSchema#integer' WHEN 'c_acctbal' THEN 'http://www.w3.org/2001/XMLSchema#float' ELSE 'http://www.w3.org/2001/XMLSchema#string' END AS datatype, c_custkey AS key FROM (DESCRIBE customer), (SELECT min(c_custkey) AS c_custkey FROM customer)")
def generated_mapping(spark, sf):
    """A mapping made from a table's schema: its rules, and that it answers a pattern."""
    table = spark.read.parquet(f"{sf}/customer.parquet")
    made = generate.mapping(table, Source.parquet("customer", f"{sf}/customer.parquet"), "http://ex/", "c_custkey")
    told = spark.createDataFrame([(p, r.path, r.datatype) for p, r in made.objects], "property string, path string, datatype string")
    key = VirtualGraph(spark, [made]).match(("?c", EX.c_custkey, "?key")).group([], key=F.min("key")).frame()
    return told.crossJoin(F.broadcast(key))  # one row


@query("SELECT 'http://ex/nation/' || n_nationkey AS n, n_name AS name FROM nation")
def rewritten_mapping(spark, sf):
    """A mapping whose class and predicate have been aligned answers patterns in the other vocabulary."""
    g = graph(spark, sf, "nation")
    maps = align.rewritten(list(g.maps.values()), {"http://ex/Nation": "http://schema.org/Country", "http://ex/name": "http://schema.org/name"})
    return VirtualGraph(spark, maps).match(("?n", TYPE, Const("http://schema.org/Country")), ("?n", Const("http://schema.org/name"), "?name")).frame()


@query("""SELECT local, accepted, source FROM (SELECT *, row_number() OVER (PARTITION BY local ORDER BY rank, confidence DESC, accepted) AS n FROM (SELECT 'http://ex/' || lang AS local, 'http://s/' || source AS accepted, ['baseline', 'local', 'external', 'proposal'][doc_id % 4 + 1] AS source, doc_id % 4 AS rank, n_chars % 10 / 10 AS confidence FROM documents)) WHERE n = 1""")
def decisions(spark, sf):
    """One decision for each local name: of the first source that has one, the most confident."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = F.array(*map(F.lit, align.CASCADE))
    rows = docs.select(F.concat(F.lit("http://ex/"), "lang").alias("local"), F.concat(F.lit("http://s/"), "source").alias("accepted"), F.get(names, (F.col("doc_id") % 4).cast("int")).alias("source"), (F.col("n_chars") % 10 / 10).alias("confidence"))
    return align.decide(rows).select("local", "accepted", "source")


@query("""WITH held AS (SELECT 'http://ex/nation' || n_nationkey AS c, n_nationkey % 4 AS v FROM nation WHERE n_nationkey % 2 = 0)
SELECT c AS cls, 'http://ex/partOf' AS property, 'http://www.w3.org/2002/07/owl#maxCardinality' AS quantifier, CAST(v AS VARCHAR) AS value FROM held""")
def restrictions(spark, sf):
    """Sound restrictions become triples; those of unknown classes, quantifiers or values don't."""
    nations = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", F.concat(F.lit("http://ex/nation"), "n_nationkey").alias("iri"))
    known = nations.filter("n_nationkey % 2 = 0").select("iri").union(spark.createDataFrame([("http://ex/partOf",)], "iri string"))
    sound = nations.select(F.col("iri").alias("class"), F.lit("http://ex/partOf").alias("property"), F.lit("maxCardinality").alias("quantifier"), (F.col("n_nationkey") % 4).cast("string").alias("value"))
    wrong = sound.withColumn("value", F.lit("many")).union(sound.withColumn("quantifier", F.lit("perhaps"))).union(sound.withColumns({"quantifier": F.lit("hasValue"), "value": F.lit("http://ex/unknown")}))
    t = align.restrictions(sound.union(wrong), known)
    pick = lambda p, name: t.filter(F.endswith("p", F.lit(p))).select(F.col("o" if p == "#subClassOf" else "s").alias("node"), F.col("s" if p == "#subClassOf" else "o").alias(name))
    values = t.filter(F.endswith("p", F.lit("ardinality"))).select(F.col("s").alias("node"), F.col("p").alias("quantifier"), F.col("o").alias("value"))
    return pick("#subClassOf", "cls").join(pick("#onProperty", "property"), "node").join(values, "node").drop("node")


@query("SELECT 'http://ex/nation/' || n_nationkey AS s, 'http://ex/partOf' AS p, 'http://ex/region/' || n_regionkey AS o FROM nation WHERE n_regionkey < 2")
def proposed_axioms(spark, sf):
    """Proposed triples of IRIs that the ontology mentions; ranges are not up for proposal."""
    nations = spark.read.parquet(f"{sf}/nation.parquet")
    iri = lambda name, key: F.concat(F.lit(f"http://ex/{name}/"), key)
    proposed = nations.select(iri("nation", "n_nationkey").alias("s"), F.lit("http://ex/partOf").alias("p"), iri("region", "n_regionkey").alias("o"))
    proposed = proposed.union(proposed.withColumn("p", F.lit("http://www.w3.org/2000/01/rdf-schema#range")))
    mentioned = nations.filter("n_regionkey < 2").select(iri("region", "n_regionkey").alias("s"), F.lit("http://www.w3.org/2000/01/rdf-schema#range").alias("p"), iri("nation", "n_nationkey").alias("o")).union(proposed.limit(0))
    known = align.known_resources(mentioned.union(nations.select(iri("nation", "n_nationkey"), F.lit("http://ex/partOf"), F.lit("text"))))
    return align.axioms(proposed, known)


@query("SELECT 'http://ex/c_' || n_nationkey AS local, 'http://schema.org/' || n_name AS accepted, 'class' AS kind FROM nation WHERE n_nationkey < 9 UNION ALL SELECT 'http://ex/c_' || n_nationkey, 'http://old/' || n_name, 'class' FROM nation WHERE n_nationkey >= 9")
def equivalences(spark, sf):
    """Decisions replace the equivalences that an ontology had for the same names."""
    nations = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", F.concat(F.lit("http://ex/c_"), "n_nationkey").alias("local"), "n_name")
    old = nations.select(F.col("local").alias("s"), F.lit(align.EQUIVALENT["class"]).alias("p"), F.concat(F.lit("http://old/"), "n_name").alias("o"))
    new = nations.filter("n_nationkey < 9").select("local", F.concat(F.lit("http://schema.org/"), "n_name").alias("accepted"))
    return align.equivalences(align.annotated(old, new, "class"))


@query("SELECT '<http://ex/nation/' || n_nationkey || '> <http://ex/name> \"' || n_name || '\" .' AS line FROM nation UNION ALL SELECT '<http://ex/nation/' || n_nationkey || '> <http://ex/partOf> <http://ex/region/' || n_regionkey || '> .' FROM nation UNION ALL SELECT '<http://ex/nation/' || n_nationkey || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://ex/Nation> .' FROM nation")
def turtle_lines(spark, sf):
    triples = graph(spark, sf, "nation").triples().select(*[F.col(c)["value"].alias(c) for c in "spo"])
    return generate.turtle(triples)
