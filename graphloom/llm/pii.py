"""Personal data in texts: patterns, and terms that disclose a protected entity (DataFrame functions only).

Base kinds are email, ip, card and phone; each distinct match is a protected entity. The method adds ``term``: words
whose pointwise mutual information with an entity comes close to the entity's own information content, as estimated
from all documents. With N documents, n(e) and n(t) that hold an entity and a term, and n(e, t) that hold both, wherever
they stand, PMI(t; e) = log2(N * n(e, t) / (n(e) * n(t))) and IC(e) = log2(N / n(e)); a term is sanitised when
PMI >= DISCLOSE * IC for any entity, in every document that holds it, whether the entity stands there or not. At
PMI >= REMOVE * IC the term is removed, below it is generalised to its class. Words inside spans of the base kinds are
masked anyway and count nowhere.

An estimate needs documents that tell something apart:

* A pair of an entity that several texts hold must stand in two that aren't copies, so that one text and its changed
  copies prove nothing. Each document has SKETCHES minima of hashed three-word runs. Of an entity's documents with a
  minimum in common, each is compared with one of them, and linked if SAME minima or more agree; linked documents are
  one component, and a pair needs two. Documents that share 0.6 of their runs agree so 997 times in 1000, those that
  share 0.045 (a footer of 40 words in texts of 440) 15 times in 1000, so that a common footer joins few of them; a
  pair is lost by this only if all of its documents are so linked. Such a term is sanitised in every document that
  holds it.
* An entity that a single text holds has n(e, t) = n(e) with each of its words, so a term's frequency in the corpus
  decides alone, and every rare word of the text would disclose it. Here a term must also stand within NEAR characters
  of the entity, and is sanitised in that text only, as nothing ties it to the entity elsewhere.

Counting is by pre-aggregated shuffles: over (entity, term) pairs, and over those words of all documents that are in a
pair. Patterns are matched once; the last pass leaves documents alone that hold neither an entity nor a listed term.

Defined results: a null or empty text has no spans; rows equal in text are treated alike, whatever their ids; texts of any
length are used whole; no documents give no rows; other columns pass through whatever their names, those named
pii_* are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import parted_by, perhaps_among, stored
from graphloom.llm.components import components
from graphloom.llm.spans import SPAN, blanked, chunks, cut, let, replaced, spans

KINDS = ("email", "ip", "card", "phone", "term")
#: No later start in a run can match when the first fails, so each run is tried once: at its start or after a match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9]|[0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"(?<!\p{L})\p{L}[\p{L}'-]{2,}+"
DISCLOSE, REMOVE = 0.8, 0.95
#: Characters on either side of an entity of one text.
NEAR = 100
#: Minima that tell documents from copies, how many agree between copies, and the words of a hashed run.
SKETCHES, SAME, RUN = 12, 3, 3


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = F.transform(F.split(F.reverse(_digits(match)), ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(digits, F.lit(0), lambda s, d: (s + d - F.when(d > 9, 9).otherwise(0)).cast("int")) % 10 == 0


def _octets(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", "").rlike("^[0-9]{1,2}$|^1[0-9]{2}$|^2[0-4][0-9]$|^25[0-5]$"))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by kind and start."""
    n = lambda m: F.char_length(_digits(m))
    return F.concat(
        spans(text, EMAIL, "email", may=F.contains(text, F.lit("@"))),
        spans(text, IP, "ip", _octets),
        spans(text, CARD, "card", _luhn),
        spans(text, PHONE, "phone", lambda m: n(m).between(9, 15), may=F.contains(text, F.lit("+"))),
    )


def _words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def _least(hashes: str, seed: int) -> Column:
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(seed))))


def _key(text: Column) -> Column:
    """Stands for a text: 128 bits of hashes."""
    return F.concat(F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(7), text)))


def _holders(texts: DataFrame) -> DataFrame:
    """From texts (text): pii_key, near, terms, sketch of documents with entities, and what masking changes in their terms.

    near: an array of (entity, terms that stand near to it), one for each span.
    """
    based = texts.select("text", base_spans(F.col("text")).alias("base")).filter(F.size("base") > 0)
    bare = based.select(_key(F.col("text")).alias("pii_key"), "text", "base", blanked(F.col("text"), F.col("base")).alias("bare"))
    split = bare.select("pii_key", "base", "bare", _words(F.col("text")).alias("raw"), _words(F.col("bare")).alias("words"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - RUN + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, RUN)))
    hashed = split.select("pii_key", "base", "bare", F.array_distinct("raw").alias("raw"), F.array_distinct("words").alias("terms"), runs.alias("runs"))

    def near(span: Column, parts: Column, length: Column) -> Column:
        left = cut(parts, F.greatest(span["start"] - NEAR, F.lit(0)), span["start"])
        right = cut(parts, span["end"], F.least(span["end"] + NEAR, length))
        # words that the edges cut aren't terms of the text, or are others of it
        words = F.array_intersect(_words(F.concat(left, F.lit(" "), right)), "terms")
        return F.struct(F.concat_ws(":", span["kind"], F.lower(span["match"])).alias("entity"), words.alias("terms"))

    beside = let(chunks(F.col("bare")), lambda parts: F.transform("base", lambda span: near(span, parts, F.char_length("bare"))))
    sketch = F.array(*[_least("runs", k) for k in range(SKETCHES)])
    lost, won = F.array_except("raw", "terms").alias("lost"), F.array_except("terms", "raw").alias("won")
    return hashed.select("pii_key", beside.alias("near"), "terms", lost, won, sketch.alias("sketch"))


def _apart(each: DataFrame) -> DataFrame:
    """entity, terms and kin of entities in more than one text; kin is the same for copies among an entity's documents."""
    more = stored(_several(each.select("entity", F.col("pii_key").alias("kin")), "entity").select("entity"), "pii-more")
    each = each.join(more, "entity").withColumn("node", F.xxhash64("entity", "pii_key"))
    nodes = stored(each.select("entity", "node", "sketch").dropDuplicates(["node"]), "pii-nodes")  # equal texts are one
    keys = nodes.select("entity", "node", F.posexplode("sketch").alias("k", "s")).select("node", F.xxhash64("entity", "k", "s").alias("bucket"))
    buckets = keys.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("other")).filter("pivot < other").select("bucket", "pivot")
    met = keys.join(buckets, "bucket").filter("node != pivot").select("pivot", "node").distinct()
    pivots = nodes.select(F.col("node").alias("pivot"), F.col("sketch").alias("pivot_sketch"))
    both = met.join(nodes.select("node", "sketch"), "node").join(pivots, "pivot")
    agree = F.size(F.filter(F.zip_with("sketch", "pivot_sketch", lambda a, b: a == b), lambda x: x))
    links = stored(both.filter(agree >= SAME).select(F.col("pivot").alias("u"), F.col("node").alias("v")), "pii-copies")
    kin = components(links).select(F.col("id").alias("node"), "component")
    return each.join(kin, "node", "left").select("entity", "terms", F.coalesce("component", "node").alias("kin"))


def _several(groups: DataFrame, *by: str) -> DataFrame:
    """Groups with two or more different kin; n counts documents."""
    counted = groups.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("kin").alias("least"), F.max("kin").alias("most"))
    return counted.filter("least < most").select(*by, "n")


def disclosing(texts: DataFrame, holders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From texts (text, never null) and their _holders(): (term, disclosure) of the terms to sanitise everywhere, and
    (pii_key, term, disclosure) of those to sanitise in one text. disclosure is the largest over all entities."""
    total = texts.agg(F.count(F.lit(1)).alias("n"))
    each = holders.select("pii_key", "terms", "sketch", F.explode(F.array_distinct(F.transform("near", lambda x: x["entity"]))).alias("entity"))
    apart = stored(_apart(each), "pii-apart")
    entities = stored(_several(apart, "entity").withColumnRenamed("n", "n_e"), "pii-entities")
    met = apart.join(entities.select("entity"), "entity").select("entity", F.explode("terms").alias("term"), "kin")
    pairs = stored(_several(met, "entity", "term").withColumnRenamed("n", "n_et"), "pii-pairs")

    one = each.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), F.min("pii_key").alias("pii_key"), F.max("pii_key").alias("other"))
    beside = holders.select("pii_key", F.explode("near").alias("near")).select("pii_key", F.col("near.entity").alias("entity"), F.explode("near.terms").alias("term")).distinct()
    single = stored(beside.join(one.filter("pii_key = other").select("pii_key", "entity", "n_e"), ["pii_key", "entity"]), "pii-single")

    candidates = stored(pairs.select("term").union(single.select("term")).distinct(), "pii-candidates")
    seen = lambda df, words, n: perhaps_among(df.select(F.explode(words).alias("term")), candidates, "term").groupBy("term").agg(F.sum(F.lit(n)).alias("n_t"))
    terms = seen(texts, F.array_distinct(_words(F.col("text"))), 1).union(seen(holders, "lost", -1)).union(seen(holders, "won", 1))
    terms = stored(terms.groupBy("term").agg(F.sum("n_t").alias("n_t")), "pii-counts")

    def scored(found: DataFrame, *by: str) -> DataFrame:
        joined = found.join(terms, "term").crossJoin(F.broadcast(total))  # one row
        pmi = F.log2(F.col("n") * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
        content = F.log2(F.col("n") / F.col("n_e"))
        strong = joined.select(*by, F.when(content > 0, pmi / content).alias("disclosure")).filter(F.col("disclosure") >= DISCLOSE)
        return strong.groupBy(*by).agg(F.max("disclosure").alias("disclosure"))

    everywhere = stored(scored(pairs.join(entities, "entity"), "term"), "pii-terms")
    return everywhere, stored(scored(single.withColumn("n_et", F.col("n_e")), "pii_key", "term"), "pii-own-terms")


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``pii_base`` (spans of the base kinds) and ``pii_spans`` (all, by kind and start).

    A term's ``match`` is the word itself, with ``-`` before it where it is to be removed.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns if not c.lower().startswith("pii_")]
    texts = docs.select(t.alias("text"))
    holders = stored(_holders(texts), "pii-holders")
    everywhere, own = disclosing(texts, holders)
    if not everywhere.isEmpty():
        words = perhaps_among(texts.select(_key(F.col("text")).alias("pii_key"), F.explode(F.array_distinct(_words(F.col("text")))).alias("term")), everywhere, "term")
        own = own.union(words.join(everywhere, "term").select("pii_key", "term", "disclosure"))
    listed = own.groupBy("pii_key", "term").agg(F.max("disclosure").alias("disclosure")).groupBy("pii_key")
    listed = stored(listed.agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("pii_terms")), "pii-listed")

    holding = holders.select("pii_key").union(listed.select("pii_key")).distinct()
    some, none = parted_by(docs.select(*kept, _key(t).alias("pii_key")), holding, "pii_key")
    some = some.withColumn("pii_base", base_spans(t)).join(listed, "pii_key", "left")
    of = lambda match: F.try_element_at("pii_terms", F.lower(match))
    hits = spans(blanked(t, F.col("pii_base")), TERM, "term", lambda m: of(m).isNotNull(), may=F.col("pii_terms").isNotNull())
    name = lambda s: F.concat(F.when(of(s["match"]) >= REMOVE, "-").otherwise(""), F.lower(s["match"]))
    hits = F.transform(hits, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), name(s).alias("match")))
    some = some.select(*kept, "pii_base", F.concat("pii_base", hits.cast(SPAN)).alias("pii_spans"))
    no = F.array().cast(SPAN)
    return some.union(none.select(*kept, no.alias("pii_base"), no.alias("pii_spans")))


def sanitised(found: DataFrame, text: str = "text") -> DataFrame:
    """The columns that were there before find(), with spans generalised to ``<kind>`` or removed."""
    mark = lambda s: F.when(F.startswith(s["match"], F.lit("-")) & (s["kind"] == "term"), F.lit("")).otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))
    kept = [c for c in found.columns if not c.lower().startswith("pii_")]
    return found.select(*[replaced(F.col(f"`{text}`"), F.col("pii_spans"), mark).alias(c) if c == text else F.col(f"`{c}`") for c in kept])
