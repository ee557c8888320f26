"""Evidence in documents: hits, coverage, table cells, review, checks of extracted values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selenite.functions.text import clean

from .joins import asof_preceding


def mentions(docs: DataFrame, key: str, text: str, wanted: DataFrame, term: str, pattern: str) -> DataFrame:
    """(key, term, n) of the wanted terms among the tokens of each text: an equi-join on tokens, not a search per term."""
    tokens = docs.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias(term))
    kept = tokens.join(wanted.select(F.lower(term).alias(term)).distinct(), term, "left_semi")
    return kept.groupBy(key, term).agg(F.count(F.lit(1)).alias("n"))


def best_relation(df: DataFrame, keys: Sequence[str], relation: str, rank: Column, position: str) -> DataFrame:
    """The relation of the greatest rank of each key; of equals the first."""
    return df.groupBy(*keys).agg(F.max_by(relation, F.struct(rank, -F.col(position))).alias(relation))


def word_rows(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Text of each visual row of words(block, line, x0, y0, y1, text), left to right."""
    return words.groupBy(*keys, "block", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ").alias("row_text"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))


def column_references(cells: DataFrame, headers: DataFrame, keys: Sequence[str], slack: float = 3.0) -> DataFrame:
    """cells(keys, x0, value) with the last header that begins at most slack to the right, or else the nearest one."""
    shifted = cells.withColumn("x", F.col("x0") + slack)
    found = asof_preceding(shifted, headers.select(*keys, F.col("x0").alias("x"), F.col("text").alias("header")), keys, "x", ["header"])
    nearest = headers.groupBy(*keys).agg(F.min_by("text", "x0").alias("leftmost"))  # none precedes: the nearest is the leftmost
    return found.join(nearest, list(keys), "left").withColumn("header", F.coalesce("header", "leftmost")).drop("x", "leftmost")


def normalized_quote(c: Column) -> Column:
    """Text as quotes are compared: lower case, straight quotes and dashes, single spaces."""
    return clean(F.translate(F.lower(c), "‘’“”–—", "''\"\"--"))


def validated(rows: DataFrame, source: str, quote: str, value: str, least: float, most: float) -> DataFrame:
    """rows with the warnings and the status of an extracted value held against its source text."""
    number = F.regexp_extract(F.col(value), r"-?[0-9]+(?:\.[0-9]+)?", 0)
    warnings = F.array_compact(
        F.array(
            F.when((number == "") | ~F.contains(F.col(source), number), "number_not_in_source"),
            F.when((number != "") & ~number.try_cast("double").between(least, most), "value_out_of_range"),
            F.when(~F.contains(normalized_quote(F.col(source)), normalized_quote(F.col(quote))), "quote_not_in_source"),
        )
    )
    out = rows.withColumn("warnings", F.array_join(warnings, ";"))
    return out.withColumn("status", F.when(F.col("warnings") == "", "accepted").otherwise("review"))


def model_json(c: Column, schema: str) -> Column:
    """The object in a model's answer: fences stripped, from the outermost brace to the last; null if it isn't JSON."""
    bare = F.regexp_replace(c, "(?m)^\\s*```[a-z]*\\s*$", "")
    return F.from_json(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def pages_before(docs: DataFrame, keys: Sequence[str], page: str, text: str, heading: str) -> DataFrame:
    """Pages before the first one with the heading; all where there is none."""
    first = F.min(F.when(F.col(text).rlike(heading), F.col(page))).over(Window.partitionBy(*keys))
    return docs.withColumn("__first", first).where(F.col("__first").isNull() | (F.col(page) < F.col("__first"))).drop("__first")


def chunks(docs: DataFrame, keys: Sequence[str], text: str, size: int) -> DataFrame:
    """Pieces of a text of at most `size` characters with their digests, as units of review."""
    count = F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")
    parts = docs.select(*keys, F.col(text).alias("__t"), F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    piece = F.substring(F.col("__t"), F.col("chunk") * size + 1, F.lit(size))
    return parts.select(*keys, "chunk", piece.alias("text"), F.sha2(piece, 256).alias("sha256"))


def status_report(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: whether it is there and its rows."""
    parts = [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n_rows")) for name, df in sorted(tables.items())]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def anchors(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, pos, href, absolute) of each anchor; root-relative and relative addresses are resolved against the page."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    found = pages.select(key, url, F.posexplode(hrefs).alias("pos", "href"))
    origin = F.regexp_extract(F.col(url), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(F.col(url), r"[?#].*$", ""), r"^([a-zA-Z][a-zA-Z0-9+.-]*://.*/)[^/]*$", 1)
    href = F.col("href")
    absolute = F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(F.col(url), "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), href)).when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(folder, href))
    return found.select(key, "pos", "href", absolute.alias("absolute"))


def document_links(pages: DataFrame, key: str, url: str, html: str, ending: str = ".pdf") -> DataFrame:
    """(key, pos, text, absolute, kind) of the anchors whose address has a path with the ending; the kind is told by words
    of the text and the address."""
    each = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["'][^"']*["'][^>]*>(.*?)(?:</a\s*>|$)"""), F.lit(1))
    texts = pages.select(F.col(key).alias("__key"), F.posexplode(each).alias("__pos", "text"))
    found = anchors(pages, key, url, html)
    path = F.regexp_replace(F.regexp_replace("absolute", "[?#].*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    found = found.where(F.lower(path).endswith(ending)).join(texts, (F.col(key) == F.col("__key")) & (F.col("pos") == F.col("__pos")))
    text = clean(F.regexp_replace("text", "<[^>]*>", " "))
    told = F.lower(F.concat_ws(" ", text, "absolute"))
    kind = F.when(F.contains(told, F.lit("compendium")), "compendium").when(told.rlike("catalog"), "catalog").otherwise("other")
    return found.select(key, "pos", text.alias("text"), "absolute", kind.alias("kind"))
