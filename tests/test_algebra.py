"""The solution algebra against plain Python, rule selection, mappings, alignment and scalars."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom import Const, Namespace, Ref, Solutions, Source, Template, TriplesMap, VirtualGraph
from graphloom.annotate import align, generate
from graphloom.functions import scalars
from graphloom.functions.terms import RDF_TYPE, XSD, compatible
from graphloom.operators import runs, vectors
from graphloom.plans.graph import construct
from graphloom.plans.rules import by_pattern, by_star, candidates, score
from graphloom.sources.mapping import Parent, rules_of
from graphloom.streaming.calls import call_windows

EX = Namespace("http://ex/")
TYPE = Const(RDF_TYPE)


# ---- joins of solutions, some unbound


def bag(solutions: Solutions, names) -> Counter:
    return Counter(tuple(r[n] for n in names) for r in solutions.frame().collect())


def agree(a: dict, b: dict) -> bool:
    return all(a[k] is None or b[k] is None or a[k] == b[k] for k in a.keys() & b.keys())


def merge(a: dict, b: dict) -> dict:
    return {k: a.get(k) if a.get(k) is not None else b.get(k) for k in a.keys() | b.keys()}


def sides(seed):
    rng = random.Random(seed)
    pick = lambda: rng.choice([None, "p", "q", "r"])
    return [{"x": pick(), "y": pick(), "l": f"l{i}"} for i in range(9)], [{"x": pick(), "y": pick(), "r": f"r{i}"} for i in range(9)]


@pytest.mark.parametrize("seed", range(3))
def test_unbound_variables(spark, seed):
    left, right = sides(seed)
    a = Solutions.of(spark.createDataFrame([tuple(d.values()) for d in left], "x string, y string, l string"))
    b = Solutions.of(spark.createDataFrame([tuple(d.values()) for d in right], "x string, y string, r string"))
    names = ("x", "y", "l", "r")
    key = lambda d: tuple(d.get(n) for n in names)
    joined = [merge(p, q) for p in left for q in right if agree(p, q)]
    assert bag(a.join(b), names) == Counter(map(key, joined))
    alone = [p for p in left if not any(agree(p, q) for q in right)]
    assert bag(a.optional(b), names) == Counter(map(key, joined)) + Counter(map(key, alone))
    assert bag(a.not_exists(b), names[:3]) == Counter(key(p)[:3] for p in alone)
    meet = lambda p, q: agree(p, q) and any(p[k] is not None and q[k] is not None for k in ("x", "y"))
    assert bag(a.minus(b), names[:3]) == Counter(key(p)[:3] for p in left if not any(meet(p, q) for q in right))
    assert bag(a.union(b), names) == Counter(map(key, left)) + Counter(map(key, right))


def people(spark, unique=True):
    rows = spark.createDataFrame([(1, "ann", 30, 2), (2, "bob", None, 3), (3, "cy", 50, 1), (3, "cy", 50, 1)][: None if not unique else 3], "id long, name string, age int, knows long")
    pets = spark.createDataFrame([("rex", 1), ("tom", 3)], "pet string, owner long")
    return [
        TriplesMap("person", Source.frame("person", lambda _: rows), Template("http://ex/person/{id}"), ((EX.name, Ref("name")), (EX.age, Ref("age", XSD + "integer")), (EX.knows, Template("http://ex/person/{knows}"))), (EX.Person.value,), unique),
        TriplesMap("pet", Source.frame("pet", lambda _: pets), Template("http://ex/pet/{pet}"), ((EX.name, Ref("pet", lang="en")), (EX.owner, Parent("person", (("owner", "id"),)))), (EX.Pet.value,), True),
    ]


@pytest.mark.parametrize("unique", [True, False])
def test_stars_and_sets(spark, unique):
    g = VirtualGraph(spark, people(spark, unique))
    found = g.match(("?p", TYPE, EX.Person), ("?p", EX.name, "?n"), ("?p", EX.knows, "?q"))
    assert bag(found, ("p", "n", "q")) == Counter({(f"http://ex/person/{i}", n, f"http://ex/person/{k}"): 1 for i, n, k in ((1, "ann", 2), (2, "bob", 3), (3, "cy", 1))})
    assert g.match(("?p", EX.age, "?a")).frame().count() == 2  # null is no triple
    assert g.match(("?x", EX.name, "?n")).frame().count() == 5
    assert g.match(("?x", EX.name, Const.literal("rex", lang="en"))).frame().count() == 1
    assert g.match(("?x", EX.name, "rex")).frame().count() == 0  # a plain literal isn't one with a language
    assert g.match(("?p", EX.age, 30)).frame().count() == 1 and g.match(("?p", EX.age, "30")).frame().count() == 0
    assert g.match((EX["person/2"], EX.name, "?n")).frame().first().n == "bob"
    assert g.match((EX["person/02"], EX.name, "?n")).frame().count() == 0
    assert g.match((EX["person/x"], EX.name, "?n")).frame().count() == 0
    assert bag(g.match(("?a", EX.owner, "?p"), ("?p", EX.name, "?n")), ("a", "n")) == Counter({("http://ex/pet/rex", "ann"): 1, ("http://ex/pet/tom", "cy"): 1})
    assert g.match(("?p", EX.knows, "?p")).frame().count() == 0
    assert g.match(("?p", EX.missing, "?m")).frame().count() == 0
    assert g.triples().count() == 3 + 3 + 2 + 3 + 2 * 3


def test_one_scan_for_a_star(spark):
    """No self-join is left for patterns of one subject, constants reach the scan, and keys are joined, not texts."""
    tables = {t: f"/root/testdata/sf0.001/{t}.parquet" for t in ("customer", "nation")}
    maps = [
        TriplesMap("c", Source.parquet("customer", tables["customer"]), Template("http://ex/c/{c_custkey}"), ((EX.segment, Ref("c_mktsegment")), (EX.nation, Template("http://ex/n/{c_nationkey}"))), (), True),
        TriplesMap("n", Source.parquet("nation", tables["nation"]), Template("http://ex/n/{n_nationkey}"), ((EX.name, Ref("n_name")),), (), True),
    ]
    found = VirtualGraph(spark, maps).match(("?c", EX.segment, "BUILDING"), ("?c", EX.nation, "?n"), ("?n", EX.name, "?name"))
    plan = found.select("c", "name").frame()._jdf.queryExecution().explainString(found.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert plan.count("FileScan") == 2 and plan.count("Join") == 1 and "NestedLoop" not in plan and "Cartesian" not in plan
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and "c_acctbal" not in plan and "http://ex/n/" not in plan


def _plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_repeated_subjects(spark):
    """Where subjects repeat, what their IRIs fix is read with another pattern, without a self-join; the rows are those of joined sets."""
    rng = random.Random(5)
    pick = lambda *x: rng.choice(x)
    rows = [(pick(1, 2, 11, None), pick(1, 2, 12, None), pick(0.5, 1.5, -0.0, 0.0, None), pick("x", "y", None), pick("1", "11", "2"), pick("1", "11", "2")) for _ in range(60)]
    df = spark.createDataFrame(rows, "a long, b int, q double, f string, s string, t string")
    order, first = Template("http://ex/o/{a}"), Template("http://ex/o/{s}")
    line = TriplesMap("line", Source.frame("line", lambda _: df), Template("http://ex/l/{a}_{b}"), ((EX.of, order), (EX.number, Ref("b", XSD + "integer")), (EX.q, Ref("q", XSD + "double")), (EX.flag, Ref("f"))), (EX.Line.value,))
    pair = TriplesMap("pair", Source.frame("pair", lambda _: df), Template("http://ex/p/{s}{t}"), ((EX.of, first), (EX.flag, Ref("f"))))  # 1 and 11, 11 and 1 are one IRI

    def wanted(subject, *objects):
        sets = [{(subject(r), o(r)) for r in rows if subject(r) is not None and o(r) is not None} for o in objects]
        found = [(x, o) for x, o in sets[0]]
        for more in sets[1:]:
            found = [(*t, o) for t in found for x, o in more if x == t[0]]
        return Counter(found)

    s = lambda r: f"http://ex/l/{r[0]}_{r[1]}" if None not in r[:2] else None
    o, b, q, f = lambda r: r[0] and f"http://ex/o/{r[0]}", lambda r: r[1], lambda r: r[2], lambda r: r[3]
    g = VirtualGraph(spark, [line, pair])
    for joins, names, patterns, parts in (
        (0, "loq", [("?l", EX.of, "?o"), ("?l", EX.q, "?q")], (o, q)),
        (0, "lqo", [("?l", EX.q, "?q"), ("?l", TYPE, EX.Line), ("?l", EX.of, "?o")], (q, o)),
        (0, "lon", [("?l", EX.of, "?o"), ("?l", EX.number, "?n")], (o, b)),
        (1, "loqf", [("?l", EX.of, "?o"), ("?l", EX.number, "?n"), ("?l", EX.q, "?q"), ("?l", EX.flag, "?f")], (o, q, f)),
        (1, "lqf", [("?l", EX.number, "?n"), ("?l", EX.q, "?q"), ("?l", EX.flag, "?f")], (q, f)),
    ):
        found = g.match(*patterns)
        assert bag(found, names) == wanted(s, *parts) and _plan(found.frame()).count("Join") == joins
    found = g.match(("?l", EX.of, EX["o/11"]), ("?l", EX.q, "?q"), ("?l", TYPE, EX.Line))
    assert bag(found, "lq") == Counter({x: 1 for x in wanted(s, q) if x[0].startswith("http://ex/l/11_")})
    assert bag(VirtualGraph(spark, [pair]).match(("?l", EX.of, "?o"), ("?l", EX.flag, "?f")), "lof") == wanted(lambda r: f"http://ex/p/{r[4]}{r[5]}", lambda r: f"http://ex/o/{r[4]}", f)


def test_joined_rows_stay_in_many_parts(spark, monkeypatch):
    """Rows of few keys compress to little; they are dealt to a number of parts that grows with the rows, and that stays."""
    lines = spark.range(40000).select((F.col("id") % 9000).alias("a"), (F.col("id") % 2).alias("b"), (F.col("id") % 7).cast("double").alias("q"))
    line = TriplesMap("line", Source.frame("line", lambda _: lines), Template("http://ex/l/{a}_{b}"), ((EX.of, Template("http://ex/o/{a}")), (EX.q, Ref("q", XSD + "double"))))

    def counted(orders):
        order = TriplesMap("order", Source.frame("order", lambda _: spark.range(orders).select("id", (F.col("id") % 3).alias("s"))), Template("http://ex/o/{id}"), ((EX.status, Ref("s", XSD + "integer")),), (), True)
        found = VirtualGraph(spark, [line, order]).match(("?l", EX.of, "?o"), ("?l", EX.q, "?q"), ("?o", EX.status, "?s"))
        return found.group(["o", "s", "q"], lines=F.count(F.lit(1))).frame()

    want = Counter((f"http://ex/o/{a}", a % 3, q) for a, b, q in {(i % 9000, i % 2, float(i % 7)) for i in range(40000)})
    at = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for part, parts in ((1 << 19, at), (4700, max(at, 9))):
        monkeypatch.setattr("graphloom.plans.graph._PART", part)
        monkeypatch.setattr("graphloom.plans.graph._KEYS", 1000)
        df = counted(9000)
        assert f", {parts}), REPARTITION_BY_NUM" in _plan(df)
        assert Counter({(r.o, r.s, r.q): r.lines for r in df.collect()}) == want
    df = counted(500)
    assert "REPARTITION_BY_NUM" not in _plan(df)
    assert Counter({(r.o, r.s, r.q): r.lines for r in df.collect()}) == Counter({k: n for k, n in want.items() if int(k[0].split("/")[-1]) < 500})


def test_inline_and_dynamic(spark):
    one = Solutions.values(spark, ["x"], [[EX.a], ["text"], [5]])
    two = Solutions.values(spark, ["x"], [[EX.a], [Const.literal("http://ex/a")], [Const.literal(5)], [Const.literal("5")]])
    assert one.join(two).frame().count() == 2  # an IRI isn't the literal of its text, nor a number that of its digits
    t = construct(one, [("?x", EX.p, "?x"), (EX.s, EX.p, "?x")])
    assert t.count() == 6


def test_term_functions(spark):
    g = VirtualGraph(spark, people(spark))
    s = g.match(("?x", EX.name, "?n")).union(g.match(("?x", EX.age, "?n")))
    s = s.bind("lang", scalars.lang(s, "n")).bind("type", scalars.datatype(s, "n")).bind("num", scalars.is_numeric(s, "n")).bind("lit", scalars.is_kind(s, "n", "literal"))
    got = Counter(tuple(r)[2:] for r in s.frame().collect())
    assert got == Counter({("", XSD + "string", False, True): 3, ("en", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", False, True): 2, ("", XSD + "integer", True, True): 2})


def test_scalars(spark):
    r = spark.range(1).select(
        scalars.round_half_up(F.lit(-2.5)).alias("a"), scalars.divide(F.lit(1), F.lit(0)).alias("b"), scalars.str_before(F.lit("a-b"), F.lit("-")).alias("c"), scalars.str_before(F.lit("ab"), F.lit("-")).alias("d"),
        scalars.encode_for_uri(F.lit("a b*~é/")).alias("e"), scalars.lang_matches(F.lit("en-GB"), "en").alias("f"), scalars.lang_matches(F.lit("eng"), "en").alias("g"), scalars.search_text(F.lit("camelCase_name  x")).alias("h"),
        scalars.safe_fragment(F.lit("--")).alias("i"), scalars.is_coverage(F.lit("http://x/?a=1&REQUEST=GetCoverage")).alias("j"), scalars.is_coverage(F.lit("http://x/?service=wfs")).alias("k"), scalars.listed(F.array(*map(F.lit, "abcdefg"))).alias("l"),
        scalars.query_metadata(F.lit("geof:sfWithin(?a) geof:sfDistance (b)")).alias("m"),
    ).first()
    assert tuple(r)[:12] == (-2, None, "a", "", "a%20b%2A~%C3%A9%2F", True, False, "camel Case name x", "NewClass", True, False, "a, b, c, d, e And 2 more")
    assert r.m.spatial_functions == 2
    assert scalars.merged_parameters(["http://x/?a=1&b=2", "http://x/?b=2&c=3"]) == "http://x/?a=1&b=2&c=3"
    with pytest.raises(ValueError):
        scalars.merged_parameters(["http://x/?a=1", "http://y/"])


# ---- selection of rules


def test_compatible_terms():
    t = Template
    assert compatible(t("http://a/{x}"), t("http://a/{y}")) and compatible(t("http://a/{x}"), t("http://a/b/{y}")) and not compatible(t("http://a/{x}"), t("http://b/{y}"))
    assert compatible(Const("http://a/5"), t("http://a/{x}")) and not compatible(Const("http://b/5"), t("http://a/{x}"))
    assert compatible("?v", Const("x")) and compatible(Const("x"), Const("x")) and not compatible(Const("x"), Const("y"))
    assert compatible(Const.literal("5"), Ref("p")) and not compatible(Const.literal(5), Ref("p")) and not compatible(Const("http://a"), Ref("p"))
    assert compatible(Const("http://a"), Ref("p", kind="iri"))


def test_selection(spark):
    rules = rules_of(people(spark))
    patterns = [("?p", TYPE, EX.Person), ("?p", EX.name, "?n")]
    assert [len(x) for x in candidates(patterns, rules)] == [1, 1]
    assert [len(x) for x in by_pattern(patterns, rules)] == [1, 2]
    assert [len(x) for x in by_star(patterns, rules)] == [1, 1]
    assert candidates([*patterns, ("?p", EX.nothing, "?z")], rules) == [[], [], []]  # one unmatched pattern empties all
    assert score([("?s", EX.a, Const.literal("x")), ("?s", EX.g, "?g")], {"?g": True}) == 40


def test_ablations_agree(spark):
    q = [("?p", EX.knows, "?q"), ("?q", EX.name, "cy"), ("?p", EX.name, "?n")]
    bags = [bag(VirtualGraph(spark, people(spark), **o).match(*q), ("p", "n")) for o in ({}, {"push": False}, {"order": "random", "seed": 1}, {"order": "random", "seed": 2}, {"select": "pattern"}, {"select": "star"})]
    assert all(b == bags[0] for b in bags) and sum(bags[0].values()) == 1


# ---- generation and alignment


def test_ontology_and_mapping(spark):
    df = spark.createDataFrame([(1, ("x", 2.0), ["a", "b"])], "id long, p struct<name: string, size: double>, tags array<string>")
    told = generate.ontology(generate.schema_rows(df, "thing"), "http://ex/")
    ranges = {r.s: r.o for r in told.filter(F.endswith("p", F.lit("#range"))).collect()}
    assert ranges["http://ex/size"] == XSD + "float" and ranges["http://ex/id"] == XSD + "long"
    m = generate.mapping(df, Source.frame("thing", lambda _: df), "http://ex/", "id")
    g = VirtualGraph(spark, [m])
    assert sorted(r.t for r in g.match(("?x", EX.tags, "?t")).frame().collect()) == ["a", "b"]
    lines = generate.turtle(told)
    again = generate.read_ntriples(lines.withColumnRenamed("line", "value"))
    assert again.count() == told.count() == again.select(F.col("s.value"), "p", F.col("o.value").alias("o")).intersect(told).count()


def test_alignment(spark):
    told = spark.createDataFrame([("http://ex/A", RDF_TYPE, align.OWL + "Class"), ("http://ex/p", RDF_TYPE, align.OWL + "DatatypeProperty"), ("http://ex/q", RDF_TYPE, align.OWL + "DatatypeProperty"), ("http://ex/p", align.EQUIVALENT["property"], "http://old/p")], "s string, p string, o string")
    offers = spark.createDataFrame([("http://ex/p", "http://new/p", "local", 0.9), ("http://ex/p", "http://new/z", "baseline", 0.1), ("http://ex/q", "http://new/b", "local", 0.8), ("http://ex/q", "http://new/a", "local", 0.8), ("http://ex/q", "http://new/x", "other", 1.0)], "local string, accepted string, source string, confidence double")
    chosen = align.decide(offers)
    assert {(r.local, r.accepted) for r in chosen.collect()} == {("http://ex/p", "http://new/z"), ("http://ex/q", "http://new/a")}
    new = align.annotated(told, chosen, "property")
    assert {(r.local, r.accepted) for r in align.equivalences(new).collect()} == {("http://ex/p", "http://new/z"), ("http://ex/q", "http://new/a")}
    assert align.without_equivalences(new).count() == 3
    assert {r.kind: r.coverage_pct for r in align.coverage(new, "http://ex/").collect()} == {"class": 0.0, "property": 100.0}
    known = align.known_resources(told)
    proposed = spark.createDataFrame([("http://ex/A", "http://ex/p", "minCardinality", "1"), ("http://ex/A", "http://ex/p", "minCardinality", "-1"), ("http://ex/A", "http://no/p", "someValuesFrom", "http://ex/A"), ("http://ex/A", "http://ex/q", "someValuesFrom", "http://ex/A"), ("http://ex/A", "http://ex/q", "odd", "http://ex/A")], "class string, property string, quantifier string, value string")
    assert align.restrictions(proposed, known).count() == 2 * 4
    axioms = spark.createDataFrame([("http://ex/p", RDF_TYPE, "http://ex/A"), ("http://ex/p", "http://www.w3.org/2000/01/rdf-schema#domain", "http://ex/A"), ("http://no", RDF_TYPE, "http://ex/A")], "s string, p string, o string")
    assert align.axioms(axioms, known).count() == 1
    maps = align.rewritten(people(spark), {"http://ex/name": "http://schema/name", "http://ex/Person": "http://schema/Person"})
    assert VirtualGraph(spark, maps).match(("?p", TYPE, Const("http://schema/Person")), ("?p", Const("http://schema/name"), "?n")).frame().count() == 3


def test_vectors(spark):
    entities = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("d", None), ("e", [float("nan"), 1.0]), ("f", [1.0]), ("g", [1.0, 0.0])], "entity string, embedding array<double>")
    terms = spark.createDataFrame([("t", [2.0, 0.0]), ("z", [0.0, 0.0]), ("n", None)], "term string, embedding array<double>")
    got = {(r.term, r["rank"], r.entity, r.score) for r in vectors.nearest(terms, entities, k=2).collect()}
    assert got == {("t", 1, "a", 1.0), ("t", 2, "g", 1.0)}
    assert vectors.nearest(terms.limit(0), entities).collect() == []
    kept = vectors.nearest_of_kind(terms, entities, F.col("entity") == "b", k=1)
    assert [(r.term, r["rank"], r.entity) for r in kept.collect()] == [("t", 1, "b")]


def test_runs(spark):
    log = spark.createDataFrame([("q", "a", "success", 1, 5, "h", 2.0), ("q", "a", "success", 2, 5, "h", 4.0), ("q", "a", "error", 3, None, None, None), ("q", "b", "success", 4, 5, "h", 1.0), ("q", "b", "success", 5, 6, "k", 2.0), ("r", "a", "error", 6, None, None, None)], "query_id string, variant string, status string, execution_order int, result_rows int, result_hash string, total_time_seconds double")
    found = {(r.query_id, r.variant): r for r in runs.summary(log, ["total_time_seconds"]).collect()}
    a, b, r = found["q", "a"], found["q", "b"], found["r", "a"]
    assert (a.runs_total, a.runs_successful, a.runs_failed, a.total_time_seconds_mean, a.result_consistent, b.result_consistent, b.result_hash) == (3, 2, 1, 3.0, True, False, "h")
    assert r.runs_successful == 0 and r.total_time_seconds_mean is None and r.result_rows is None and r.result_consistent
    c = runs.compare(runs.summary(log, ["total_time_seconds"]), "a", "b", ["total_time_seconds"]).collect()
    assert len(c) == 1 and c[0].speedup == 2.0 and c[0].total_time_seconds_reduction_pct == 50.0 and c[0].result_hash_match
    rate = {(x.query_id, x.variant): x.success_rate for x in runs.success_rate(log).collect()}
    assert rate == {("q", "a"): pytest.approx(2 / 3), ("q", "b"): 0.5, ("r", "a"): 0.0}
    assert runs.pending(log.select("query_id", "variant").distinct(), log.filter("status = 'success'"), ["query_id", "variant"]).count() == 1


def test_stream(spark, tmp_path):
    """The same windows from a stream as from a batch, once the watermark has passed them."""
    rows = spark.createDataFrame([(f"2024-01-01 0{h}:{m:02d}:00", "k", 1.0) for h in range(4) for m in (0, 30)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = call_windows(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("calls").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("calls").collect())) == sorted(map(tuple, call_windows(rows).collect()))
