"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Four kinds of protected entities are found by pattern. Then, with corpus counts of documents, a term w beside an entity e
discloses the share PMI(w; e) / IC(e) of its information, where PMI = log2(c(w,e) N / (c(w) c(e))) and
IC = log2(N / c(e)); c(w,e) counts documents with both, c(w) and c(e) those with w and e at all. Terms at or above the
threshold are protected too, wherever they stand in a document with the entity.

Patterns are written so that Java's matcher neither recurses with the text's length nor rescans a run: a match starts at
the start of its run or at the end of the last match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9.-]+?(?=\.\.|\.?(?![A-Za-z0-9.-]))",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap necessary conditions of a match.
_MAYBE = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), "phone": lambda t: t.contains("+")}
TERM = r"[\p{L}\p{N}]+"
#: Bits of the filter for the terms to be counted.
FILTER_WORDS = 1 << 17
_HIT = "array<struct<kind:string,i:int,gap:int,hit:string>>"


def _matched(text: Column, pattern: str) -> Column:
    """Matches of a pattern in order, each with the length of the text since the one before."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.zip_with(hits, F.slice(F.transform(gaps, F.length), F.lit(1), F.size(hits)), lambda h, g: F.struct(g.alias("gap"), h.alias("hit")))


def _hits(text: Column, kind: str) -> Column:
    """Matches of a kind's pattern, each with the length of the text before it."""

    def row(x: Column, i: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["hit"].alias("hit"))

    pairs = _matched(text, PATTERNS[kind])
    return F.when(_MAYBE[kind](text), F.transform(pairs, row)).otherwise(F.array().cast(_HIT))


def _luhn(digits: Column) -> Column:
    def weight(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.pmod(F.length(digits) - i, F.lit(2)) == 1
        return F.when(~twice, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + weight(i)) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(hit, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.try_to_number(part(p), F.lit("999")), F.lit(999)) <= 255))
    if kind == "card":
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _terms(rows: DataFrame) -> DataFrame:
    """(key, start, end, term) of the terms of three letters and more in rows(key, text)."""
    every = rows.select("key", F.posexplode(_matched(F.col("text"), TERM)).alias("i", "x")).select("key", "i", "x.gap", "x.hit")
    upto = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = every.withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(upto).cast("int"))
    return placed.where(F.length("hit") >= 3).select("key", (F.col("end") - F.length("hit")).alias("start"), "end", F.lower("hit").alias("term"))


def _among(terms: DataFrame) -> Column:
    """A fixed-size bit table of the terms, as a scalar: a filter that lets some others pass."""
    h = F.pmod(F.xxhash64("term"), F.lit(FILTER_WORDS * 64))
    bits = terms.select(F.floor(h / 64).alias("id"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int")).alias("bit")).groupBy("id").agg(F.bit_or("bit").alias("bit"))
    every = terms.sparkSession.range(FILTER_WORDS).join(bits, "id", "left").select("id", F.coalesce("bit", F.lit(0)).alias("bit"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bit"))), lambda x: x["bit"]).alias("bits")).scalar()


def personal_spans(docs: DataFrame, threshold: float = 0.8, least: int = 2) -> DataFrame:
    """(key, doc_id, base, terms) of every row of docs(doc_id, text): spans of the kinds, and of terms that disclose them.

    threshold is the share of an entity's information at which a term discloses it; least is the number of documents in
    which both must stand, as in one document every rare word would disclose every entity. Entities are compared by kind and by
    text, lower-cased for e-mail and as digits for cards and phones. key is a hash of doc_id and text: rows repeated
    whole share it. A null text is empty and has no spans. Terms overlapping base spans are left out. Other columns are
    not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", text.alias("text"))
    found = materialize(rows.select("key", "doc_id", F.concat(*(_hits(F.col("text"), kind) for kind in KINDS)).alias("hits")), "hits")
    n_docs = found.count()

    # Places: the gaps and matches of a row's kind, summed in order.
    once = found.where(F.size("hits") > 0).dropDuplicates(["key"]).select("key", F.inline("hits"))
    upto = Window.partitionBy("key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = once.withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(upto).cast("int")).withColumn("start", F.col("end") - F.length("hit"))
    valid = F.lit(False)
    for kind in KINDS:
        valid = F.when(F.col("kind") == kind, _valid(kind, F.col("hit"))).otherwise(valid)
    placed = materialize(placed.where(valid), "placed")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    base = placed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("k"), "end", "kind"))).alias("base"))
    base = materialize(base, "base")

    value = F.when(F.col("kind") == "email", F.lower("hit")).when(F.col("kind").isin("card", "phone"), F.regexp_replace("hit", "[^0-9]", "")).otherwise(F.col("hit"))
    entities = placed.select("key", F.concat_ws(":", "kind", value).alias("entity")).distinct()
    c_e = materialize(entities.groupBy("entity").agg(F.count(F.lit(1)).alias("c_e")).where(F.col("c_e").between(least, n_docs - 1)), "c_e")
    held = materialize(entities.join(c_e.select("entity"), "entity", "left_semi"), "held")
    texts = rows.select("key", "text").join(held.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    clear = ~F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    seen = materialize(_terms(texts).join(base, "key").where(clear).select("key", "start", "end", "term"), "seen")
    together = seen.select("key", "term").distinct().join(held, "key").groupBy("entity", "term").agg(F.count(F.lit(1)).alias("c_we")).where(F.col("c_we") >= least)
    together = materialize(together, "together")
    terms = together.select("term").distinct()
    bits = _among(terms)
    h = lambda w: F.pmod(F.xxhash64(w), F.lit(FILTER_WORDS * 64))
    known = lambda w: F.call_function("shiftright", F.get(bits, F.floor(h(w) / 64).cast("int")), F.pmod(h(w), F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
    words = rows.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("term"))
    c_w = words.where(known(F.col("term"))).groupBy("term").agg(F.count(F.lit(1)).alias("c_w"))
    scored = together.join(materialize(c_w, "c_w"), "term").join(c_e, "entity")
    pmi = F.log2(F.col("c_we") * F.lit(float(n_docs)) / (F.col("c_w") * F.col("c_e")))
    told = materialize(scored.where(pmi >= threshold * F.log2(F.lit(float(n_docs)) / F.col("c_e"))).select("entity", "term"), "told")
    hits = seen.join(held, "key").join(told, ["entity", "term"]).select("key", "start", "end").distinct()
    of_row = hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("terms"))
    out = found.select("key", "doc_id").join(base, "key", "left").join(materialize(of_row, "terms"), "key", "left")
    none = F.array().cast(base.schema["base"].dataType), F.array().cast("array<struct<start:int,end:int>>")
    return out.select("key", "doc_id", F.coalesce("base", none[0]).alias("base"), F.coalesce("terms", none[1]).alias("terms"))


def all_spans() -> Column:
    """Of a row of personal_spans: base spans and terms by start, then kind as listed with terms last."""
    order = F.array(*map(F.lit, (*KINDS, "term")))
    every = F.concat(F.transform("base", lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["kind"]).alias("k"), x["end"].alias("end"), x["kind"].alias("kind"))), F.transform("terms", lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS) + 1).cast("long").alias("k"), x["end"].alias("end"), F.lit("term").alias("kind"))))
    return F.array_sort(every)


def sanitized(docs: DataFrame, threshold: float = 0.8, least: int = 2) -> DataFrame:
    """docs with each protected span generalised to its kind in brackets, and disclosing terms removed as [term].

    Spans that overlap are one, of the first one's kind.
    """
    found = personal_spans(docs, threshold, least).dropDuplicates(["key"]).select("key", F.inline(all_spans()))
    order = Window.partitionBy("key").orderBy("start", "k")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("new", F.coalesce((F.col("start") >= before).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(order))
    spans = islands.groupBy("key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "k")).alias("kind"))
    kept = materialize(spans.groupBy(F.col("key").alias("__key")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("__spans")), "found")
    rows = docs.withColumn("__key", F.xxhash64("doc_id", "text")).join(kept, "__key", "left")

    def piece(x: Column, i: Column) -> Column:
        begin = F.coalesce(F.get("__spans", i - 1)["end"], F.lit(0))
        return F.concat(F.substring(F.col("text"), begin + 1, x["start"] - begin), F.lit("["), x["kind"], F.lit("]"))

    tail = F.substring(F.col("text"), F.element_at("__spans", -1)["end"] + 1, F.length("text"))
    text = F.concat(F.array_join(F.transform("__spans", piece), ""), tail)
    return rows.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(text)).select(*docs.columns)
