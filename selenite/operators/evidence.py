"""Evidence in texts and tables: kinds of hits, relations, scopes, header rows, table cells and what must be reviewed.

The patterns and words below are fixed values; all functions stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selenite.functions.text import clean

# Spellings of the maturity index and of words that go with it, phases, headings, relations.
INDEX = r"(?i)(?<![A-Za-z0-9])(?:I\s*_?\s*s|I\s*[- ]?sub\s*[- ]?s|Iₛ)\s*(?:/|\\|per)\s*Fe\s*O(?![A-Za-z])"
NAMED_INDEX = r"(?i)\bMorris(?:'s)?\s+(?:maturity\s+)?index\b"
MATURITY = r"(?i)\b(?:very\s+)?(?:im\s*mature|sub\s*mature|mature|maturity)\b"
OXIDE = r"(?im)(?<![A-Za-z])FeO(?![A-Za-z])"
PHASE = r"(?i)\b(?:mineral|pyroxene|olivine|plagioclase|ilmenite|spinel|glass|clinopyroxene|orthopyroxene|feldspar)\b"
COMPOSITION = r"(?i)\b(?:chemical|major[- ]element|bulk)\s+composition\s+of\s+(?:sample\s+)?[0-9]{4,6}\b"
ALLOCATION = r"(?i)\b(?:processing|allocat(?:ion|ed|e)?|split|subsample|daughter|parent|reserve|surface|subsurface)\b"
DISCUSSION = r"(?i)\b(?:sample|soil|rock|breccia|basalt|clast)\b"
RELATIONS = {"chemistry_table_heading": 4, "allocation_or_split": 3, "document_title_or_heading": 2, "sample_discussion": 1, "mentioned_in_pdf": 0}
AUTHOR_YEAR = r"^(?:(?i:[A-Z][A-Za-z’'\-]*|[A-Z]{2,})[0-9]{2,4}[A-Za-z]?|(?i:LSPET)[0-9]{2})$"
AUTHOR = r"^[A-Z][A-Za-z’'\-]{3,}$"
CONNECTORS = ("in", "and", "&", "et", "al", "al.")


def hit_kind(text: Column) -> Column:
    """What a text says of maturity: the explicit index, the named one, words alone, or nothing."""
    return F.when(text.rlike(INDEX), "explicit_is_feo").when(text.rlike(NAMED_INDEX), "morris_index").when(text.rlike(MATURITY), "qualitative_maturity").otherwise("")


def around_hits(text: Column, pattern: str, before: int, after: int) -> Column:
    """array<struct<before, hit, after>> of every match, whatever others are near it."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    lengths = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(F.length(g).alias("gap"), F.length(h).alias("n")))
    ends = F.aggregate(lengths, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array((F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x["gap"] + x["n"]).cast("int"))))

    def cut(hit: Column, end: Column) -> Column:
        start = end - F.length(hit)
        first = F.greatest(start - before, F.lit(0))
        return F.struct(F.substring(text, first + 1, start - first).alias("before"), hit.alias("hit"), F.substring(text, end + 1, F.lit(after)).alias("after"))

    return F.zip_with(hits, ends, cut)


def candidate_kind(evidence: Column, has_values: Column) -> Column:
    """Measurement, table, graph or citation: how a text with the index states its values."""
    lower = F.lower(clean(evidence))
    cited = (F.regexp_count(evidence, F.lit(INDEX)) == 1) & F.contains(lower, F.lit("surface exposure")) & F.contains(lower, F.lit("compilation")) & F.contains(lower, F.lit("morris"))

    def states(x: Column) -> Column:
        window = clean(F.concat(x["before"], x["hit"], x["after"]))
        follows = x["after"].rlike(r"^\s*[,):]?\s*=\s*[<>~≈]?\s*[0-9]")
        return follows | window.rlike(r"(?i)\b(?:is|are|was|were|as)\s*[<>~≈]?\s*[0-9]") | x["before"].rlike(r"[<>~≈]?\s*[0-9]+(?:\.[0-9]+)?\s*$")

    statement = F.contains(lower, F.lit("respectively")) | F.exists(around_hits(evidence, INDEX, 180, 220), states)
    return (
        F.when(cited, "citation_only").when(~has_values, "text_only_or_citation").when(statement, "numeric_statement")
        .when(evidence.rlike(r"(?i)\btable\b"), "numeric_table_or_layout").otherwise("numeric_graph_or_ambiguous")
    )


def context_relation(sample: Column, page: Column, line: Column, context: Column) -> Column:
    """struct(relation, rank): how a document speaks of a sample; the greatest rank says most."""
    compact = clean(context)
    heading = F.concat(F.lit(r"(?i)(?:chemical\s+composition[^\n]{0,80}\Q"), sample, F.lit(r"\E|\Q"), sample, F.lit(r"\E[^\n]{0,80}chemical\s+composition)"))
    title = (F.trim(line) == sample) | ((page == 1) & F.regexp_like(line, F.concat(F.lit(r"^\s*\Q"), sample, F.lit(r"\E\b"))))
    kind = (
        F.when(F.regexp_like(compact, heading), "chemistry_table_heading").when(compact.rlike(ALLOCATION), "allocation_or_split")
        .when(title, "document_title_or_heading").when(compact.rlike(DISCUSSION), "sample_discussion").otherwise("mentioned_in_pdf")
    )
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in RELATIONS.items() for x in pair)), kind)
    return F.struct(kind.alias("relation"), rank.alias("rank"))


def document_kind(text: Column, url: Column) -> Column:
    both = F.lower(F.concat_ws(" ", text, url))
    return F.when(F.contains(both, F.lit("compendium")), "compendium").when(both.rlike("catalog"), "catalog").otherwise("other_pdf")


def says_oxide(text: Column) -> Column:
    return F.coalesce(text.rlike(OXIDE), F.lit(False))


def heading_scope(heading: Column) -> Column:
    """What a table's heading says that its values are of; a phase is no whole sample."""
    return F.when(heading.rlike(PHASE), "mineral_phase").when(heading.rlike(COMPOSITION), "bulk_or_whole_sample").otherwise("unspecified")


def header_tokens(words: Column) -> Column:
    """array<struct<text, x0, x1, complex>> of the references in a header row: array<struct<text, x0, x1>>, left to right.

    An author with a year begins one; connectors, what follows them and other words are taken into the one before, which
    is complex then, as is an author without a year.
    """
    start = F.array().cast("array<struct<text:string,x0:double,x1:double,complex:boolean>>")

    def step(acc: Column, w: Column) -> Column:
        text = F.regexp_replace(w["text"], "^[ ,;:]+|[ ,;:]+$", "")
        last = F.get(acc, F.size(acc) - 1)
        joins_on = F.lower(F.element_at(F.split(F.coalesce(last["text"], F.lit("")), " "), -1)).isin(*CONNECTORS)
        is_year, is_author = text.rlike(AUTHOR_YEAR), text.rlike(AUTHOR)
        begins = (is_year & ~joins_on) | (is_author & ~is_year)
        new = F.struct(text.alias("text"), w["x0"].alias("x0"), w["x1"].alias("x1"), (~is_year).alias("complex"))
        longer = F.struct(F.concat_ws(" ", last["text"], text).alias("text"), last["x0"].alias("x0"), w["x1"].alias("x1"), F.lit(True).alias("complex"))
        with_last = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))
        return F.when((text == "") | (F.lower(text) == "reference"), acc).when(begins, F.concat(acc, F.array(new))).when(F.size(acc) > 0, with_last).otherwise(acc)

    return F.aggregate(words, start, step)


def mapped_reference(headers: Column, x0: Column, slack: float = 3.0) -> Column:
    """The last header that begins at most slack right of x0, or else the nearest one."""
    before = F.filter(headers, lambda h: h["x0"] <= x0 + slack)
    return F.when(F.size(before) > 0, F.element_at(before, -1)).when(F.size(headers) > 0, F.array_sort(headers, lambda a, b: F.when(F.abs(a["x0"] - x0) < F.abs(b["x0"] - x0), -1).when(F.abs(a["x0"] - x0) > F.abs(b["x0"] - x0), 1).otherwise(0))[0])


def table_cells(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Measurements of value rows, and the review queue.

    rows: a row per value row of a page with document, page, y0, ids array<string>, words and header array<struct<text,
    x0, x1>> left to right (header null without a reference row above), heading, methods map<string, string>. A number
    after a plus-minus sign is the uncertainty of the one before it; a letter in brackets is its method. Blank rows give
    nothing, and a zero is a value. The queue holds rows without a reference row and measurements with any reason.
    """
    indexed = rows.withColumn("__headers", header_tokens(F.coalesce("header", F.array().cast("array<struct<text:string,x0:double,x1:double>>"))))
    indexed = indexed.select("*", F.posexplode("words").alias("__at", "__w"))
    text = lambda k: F.trim(F.get("words", F.col("__at") + k)["text"])
    number = F.trim(F.col("__w.text"))
    sign = ("±", "+/-")
    is_value = number.rlike(r"^[<>~≈]?[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)$") & ~F.coalesce(text(-1).isin(*sign), F.lit(False))
    found = indexed.where(is_value)
    spread = F.when(text(1).isin(*sign), text(2))
    code = F.lower(F.regexp_extract(F.when(spread.isNotNull(), text(3)).otherwise(text(1)), r"^\(?([A-Za-z])\)?$", 1))
    reference = mapped_reference(F.col("__headers"), F.col("__w.x0"))
    scope = F.when(F.col("header").isNotNull(), heading_scope(F.coalesce("heading", F.lit("")))).otherwise("unspecified")
    found = found.withColumn("__reference", reference).withColumn("scope", scope).withColumn("method_code", F.coalesce(code, F.lit("")))
    method = F.try_element_at("methods", F.col("method_code"))
    reasons = F.array_compact(F.array(
        F.when(F.col("header").isNull(), "no_reference_header"), F.when(F.col("__reference").isNull(), "value_not_mapped_to_reference"), F.when(F.col("__reference.complex"), "complex_reference_header"),
        F.when(F.size("ids") != 1, "zero_or_multiple_sample_ids"), F.when(F.col("scope") == "unspecified", "sample_scope_unspecified"), F.when((F.col("method_code") != "") & method.isNull(), "method_code_not_resolved"),
    ))
    bare = F.regexp_replace(number, "^[<>~≈]", "")
    cells = found.select(
        "document", "page", F.array_join("ids", ",").alias("sample_id"), bare.cast("double").alias("value"), F.when(bare != number, F.substring(number, 1, 1)).otherwise("").alias("qualifier"), spread.cast("double").alias("uncertainty"),
        F.coalesce("__reference.text", F.lit("")).alias("reference"), "method_code", F.coalesce(method, F.lit("")).alias("method"), "scope", F.col("__w.x0").alias("x0"), "y0", reasons.alias("__reasons"),
    )
    confidence = F.when(F.size("__reasons") == 0, "high").when((F.col("reference") != "") & ~F.array_contains("__reasons", "no_reference_header"), "medium").otherwise("low")
    cells = cells.withColumn("confidence", confidence).withColumn("review_reason", F.array_join("__reasons", ";")).drop("__reasons")
    lost = rows.where(F.col("header").isNull() & F.exists("words", lambda w: w["text"].rlike("[0-9]"))).select("document", "page", F.lit("value_row_without_reference_header").alias("issue"), F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("details"))
    under = cells.where("review_reason <> ''").select("document", "page", F.lit("measurement_needs_review").alias("issue"), F.col("review_reason").alias("details"))
    return cells, lost.unionByName(under)


def metadata_hits(lines: DataFrame, keys: Sequence[str], line: str, text: str, excluded: str, around: int = 2) -> DataFrame:
    """(keys, kind, evidence, line): lines with a hit and their neighbours, each kind and evidence of a key once; sources that
    match `excluded` are left out. The lines of one key are one file."""
    w = Window.partitionBy(*keys).orderBy(line)
    context = clean(F.array_join(F.collect_list(F.coalesce(F.col(text), F.lit(""))).over(w.rowsBetween(-around, around)), " "))
    found = lines.withColumn("evidence", context).withColumn("kind", hit_kind(F.coalesce(F.col(text), F.lit(""))))
    kept = found.where((F.col("kind") != "") & ~F.col("evidence").rlike(excluded))
    return kept.groupBy(*keys, "kind", "evidence").agg(F.min(line).alias(line))


def category_blocks(lines: DataFrame, keys: Sequence[str], line: str, text: str, categories: dict[str, str], around: int) -> DataFrame:
    """(keys, category, start, end, n_hits): runs of lines near the hits of each category, merged where they touch."""
    from .sequences import merge_intervals

    named = F.array_compact(F.array(*(F.when(F.col(text).rlike(p), F.lit(c)) for c, p in categories.items())))
    hits = lines.select(*keys, F.explode(named).alias("category"), F.greatest(F.col(line) - around, F.lit(0)).alias("start"), (F.col(line) + around + 1).alias("end"))
    return merge_intervals(hits, [*keys, "category"], "start", "end", 0).withColumnRenamed("n_merged", "n_hits")


def rolled_up(status: DataFrame, stage: str, state: str, sums: Sequence[str]) -> DataFrame:
    """Per stage: rows, rows of each state as a map, and the sums of the counters."""
    by_state = status.groupBy(stage, state).agg(F.count(F.lit(1)).alias("__n"), *(F.sum(c).alias(c) for c in sums))
    return by_state.groupBy(stage).agg(F.sum("__n").alias("n_rows"), F.array_join(F.array_sort(F.collect_list(F.concat(F.col(state).cast("string"), F.lit("="), F.col("__n").cast("string")))), ";").alias("states"), *(F.sum(c).alias(c) for c in sums))
