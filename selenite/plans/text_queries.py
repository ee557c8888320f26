"""Queries of the readings of cells: truth values, numbers, ids, legends, answers, neighbours, each beside its SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from selenite.functions import numeric, text
from selenite.operators import documents, joins, sequences, spectral
from selenite.streaming import incremental

from .queries import query, table


def _one_of(forms: Sequence[str | Column | None], at: Column) -> Column:
    """The form whose turn it is."""
    return F.element_at(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in forms)), (at % len(forms) + 1).cast("int"))


@query("""
WITH w AS (SELECT p_partkey, lower(trim(['', '0', 'False', ' n ', 'no', 'NO ', 'none', 'null', '1', 'TRUE', 't', 'yes', 'maybe', NULL][p_partkey % 14 + 1])) AS w FROM part)
SELECT p_partkey, coalesce(w, '') NOT IN ('', '0', 'false', 'n', 'no', 'none', 'null') AS not_false, coalesce(w, '') IN ('1', 'true', 't', 'y', 'yes') AS is_true, coalesce(w = 'no', false) AS says_no FROM w""")
def truth_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three readings of a truth value."""
    words = _one_of(["", "0", "False", " n ", "no", "NO ", "none", "null", "1", "TRUE", "t", "yes", "maybe", None], F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", text.not_false(words).alias("not_false"), text.is_true(words).alias("is_true"), text.says_no(words).alias("says_no"))


@query("""
WITH n AS (SELECT p_partkey, p_partkey % 8 AS form, p_size FROM part), v AS (SELECT *, CASE form WHEN 0 THEN p_size WHEN 1 THEN p_size * 1000 WHEN 2 THEN -p_size WHEN 3 THEN 0.5 WHEN 4 THEN p_size END AS x FROM n)
SELECT p_partkey, CAST(x AS DOUBLE) AS number, CAST(CASE WHEN x >= 0 THEN x END AS DOUBLE) AS positive, CAST(p_size AS DOUBLE) AS strict FROM v""")
def tolerant_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that cells spell, none where they spell none or no finite one; and a reading that stops at such a cell."""
    size = F.col("p_size").cast("string")
    cell = _one_of([size, F.concat(size, F.lit("e3")), F.concat(F.lit(" -"), size, F.lit(" ")), ".5", F.concat(size, F.lit(".")), "inf", F.concat(size, F.lit(" wt%")), None], F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", text.number(cell).alias("number"), text.number(cell, 0.0).alias("positive"), text.strict_number(size, F.col("p_name")).alias("strict"))


@query("""
WITH c AS (SELECT p_partkey, p_size, ['', CAST(p_partkey AS VARCHAR), p_partkey || 'a', 'B' || p_partkey][p_partkey % 4 + 1] AS child, CASE WHEN p_partkey % 4 IN (1, 2) THEN p_partkey END AS number, [0, 1, 1, 2][p_partkey % 4 + 1] AS rank FROM part)
SELECT p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY rank, number NULLS FIRST, upper(child), p_partkey) AS place FROM c""")
def child_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of a parent in order: the parent itself, numbers with their suffixes as numbers, then names."""
    key = F.col("p_partkey").cast("string")
    child = _one_of(["", key, F.concat(key, F.lit("a")), F.concat(F.lit("b"), key)], F.col("p_partkey"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", text.child_key(child).alias("k"))
    return sequences.first_of_each(rows, ["p_size"], [F.col("k").asc_nulls_first(), F.col("p_partkey")], 1 << 30).select("p_partkey", F.col("rank").cast("long").alias("place"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size || '.5,12,13' ELSE p_size || '.5' END AS near, [CAST(p_size AS DOUBLE), p_partkey + 0.25, 1.2] AS every FROM part""")
def numbers_at_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers near each hit of a term, also where windows overlap, without ids, years and large ones; and all of a text."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    # the second hit stands within the first one's window, and 13 in its own alone
    more = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" " * 250), F.lit("FeO 12"), F.lit("x" * 200), F.lit(" 13"))).otherwise("")
    line = F.concat(F.lit("sample 10084 of 1971: FeO "), size, F.lit(".5 and 300"), more, F.lit("x" * 400), F.lit(" 77"))
    every = text.numbers_in(F.concat(F.lit("v"), size, F.lit(" and "), key, F.lit(".25, 1.2.3")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.numbers_near(line, "FeO"), ",").alias("near"), every.alias("every"))


@query("""
SELECT n_nationkey, 'a' AS code, lower(n_name) || ', in two steps' AS method FROM nation UNION ALL SELECT n_nationkey, 'b', 'probe ' || n_regionkey FROM nation""")
def legend_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of a legend line with what they stand for."""
    line = F.concat(F.lit("Notes. Technique: ( A ) "), F.lower("n_name"), F.lit(", in two steps; , (B)  probe "), F.col("n_regionkey").cast("string"), F.lit("."))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(text.legend_codes(line)).alias("code", "method"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 < 2 THEN n_name END AS name, CASE WHEN n_nationkey % 3 < 2 THEN n_regionkey END AS region FROM nation")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects in a model's answers, plain, fenced within prose, or broken."""
    whole = F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    answer = _one_of([whole, F.concat(F.lit("Here it is:\n```json\n"), whole, F.lit("\n```\nDone.")), "I found {nothing"], F.col("n_nationkey"))
    got = documents.model_json(answer, "name string, region int")
    return table(spark, sf_dir, "nation").select("n_nationkey", got.alias("g")).select("n_nationkey", "g.name", "g.region")


@query("""
WITH f AS (SELECT conv_id, min(turn) FILTER (regexp_matches(text, '[.] [D-F]')) AS first FROM conversations GROUP BY 1)
SELECT conv_id, turn FROM conversations JOIN f USING (conv_id) WHERE first IS NULL OR turn < first""")
def pages_before_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before the first page with the heading; all of a document that has none."""
    return documents.pages_before(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", "[.] [D-F]").select("conv_id", "turn")


@query("""
SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INT) AS DOUBLE) AS value, CASE WHEN l_linenumber % 3 = 0 THEN 0.5::DOUBLE END AS uncertainty, ['a', 'b', NULL][l_linenumber % 3 + 1] AS method
FROM (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1)""")
def neighbour_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a row of words with the uncertainty after a plus-minus sign and the code of the method."""
    q = F.col("l_quantity").cast("int").cast("string")
    tokens = _one_of([F.array(q, F.lit("±"), F.lit("0.5"), F.lit("(a)")), F.array(q, F.lit("b")), F.array(F.concat(F.lit("<"), q), F.lit("trace"))], F.col("l_linenumber"))
    lines = joins.uncovered(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").count().where("count > 1"), ["l_orderkey", "l_linenumber"])
    words = lines.select("l_orderkey", "l_linenumber", F.posexplode(tokens).alias("k", "token")).withColumn("at", F.col("l_linenumber") * 10 + F.col("k"))
    return sequences.neighbour_tokens(words, ["l_orderkey"], "at", "token").select("l_orderkey", F.floor(F.col("at") / 10).cast("int").alias("l_linenumber"), "value", "uncertainty", "method")


@query("SELECT c_custkey, c_nationkey AS n_nationkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def unique_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on a key that must be unique on the right."""
    left = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return joins.unique_join(left, table(spark, sf_dir, "nation"), "n_nationkey")


@query("""
WITH r AS (SELECT 'd' || s_nationkey || '/f' || s_suppkey % 70 || '.tab' AS path, s_suppkey AS k FROM supplier), w AS (SELECT path, min(k) AS k FROM r GROUP BY 1), b AS (SELECT split_part(path, '/', 2) AS base, min(k) AS k FROM r GROUP BY 1 HAVING count(*) = 1),
l AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'd' || s_nationkey ELSE 'moved' END || '/f' || (s_suppkey % 90) || '.tab' AS path FROM supplier)
SELECT s_suppkey, l.path, coalesce(w.k, b.k) AS k FROM l LEFT JOIN w USING (path) LEFT JOIN b ON b.base = split_part(l.path, '/', 2)""")
def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of files by their whole path, or by a file name that only one has."""
    rows = table(spark, sf_dir, "supplier")
    name = lambda folder, n: F.concat(folder, F.lit("/f"), (F.col("s_suppkey") % n).cast("string"), F.lit(".tab")).alias("path")
    own = F.concat(F.lit("d"), F.col("s_nationkey").cast("string"))
    right = rows.select(name(own, 70), F.col("s_suppkey").alias("k")).groupBy("path").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("n"))
    right = right.select("path", "k", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).drop("col")
    left = rows.select("s_suppkey", name(F.when(F.col("s_suppkey") % 2 == 0, own).otherwise("moved"), 90))
    return joins.resolve_path(left, right, "path", ["k"])


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0")
def unchanged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were done with the text that they still have."""
    docs = table(spark, sf_dir, "documents")
    done = docs.where("doc_id % 2 = 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return joins.unchanged(docs.select("doc_id", F.sha2("text", 256).alias("h")), done, "doc_id", "h").select("doc_id")


@query("""
WITH u AS (SELECT page_id, url || CASE WHEN page_id % 3 = 0 THEN '/report 7.pdf?x=1' WHEN page_id % 3 = 1 THEN '/' ELSE '' END AS url FROM pages), s AS (SELECT *, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) AS last FROM u)
SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(trim(regexp_replace(last, '\\.[A-Za-z0-9]+$', '')), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'document') || '__pdf__' || left(sha256(url), 10) AS id FROM s""")
def document_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of documents from their addresses: stem, kind and ten digits of the digest."""
    url = F.concat("url", F.when(F.col("page_id") % 3 == 0, "/report 7.pdf?x=1").when(F.col("page_id") % 3 == 1, "/").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", text.document_id(url, F.lit("pdf")).alias("id"))


@query("""
WITH c AS (SELECT s_suppkey, n_regionkey, s_suppkey % 100 AS x0 FROM supplier JOIN nation ON n_nationkey = s_nationkey), h AS (SELECT n_regionkey, n_nationkey * 4 + 10 AS x0, n_name FROM nation)
SELECT s_suppkey, coalesce((SELECT max_by(n_name, h.x0) FROM h WHERE h.n_regionkey = c.n_regionkey AND h.x0 <= c.x0 + 3), (SELECT min_by(n_name, h.x0) FROM h WHERE h.n_regionkey = c.n_regionkey)) AS header FROM c""")
def cell_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a table with the header above them."""
    nation = table(spark, sf_dir, "nation")
    cells = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey", (F.col("s_suppkey") % 100).cast("double").alias("x0"))
    heads = nation.select("n_regionkey", (F.col("n_nationkey") * 4 + 10).cast("double").alias("x0"), F.col("n_name").alias("text"))
    return documents.column_references(cells, heads, ["n_regionkey"]).select("s_suppkey", "header")


@query("""
WITH w AS (SELECT CAST(p_size AS DOUBLE) AS axis, CAST(p_partkey % 5 + 1 AS INT) AS band, sum(p_partkey % 7 + 1.0) AS weight FROM part GROUP BY ALL)
SELECT band, round(sum(axis * weight) / sum(weight), 6) AS centre FROM w GROUP BY 1""")
def checked_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of bands that must all be there, none negative and none without any weight, to the centres of the bands."""
    weights = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("double").alias("axis"), (F.col("p_partkey") % 5 + 1).cast("int").alias("band")).agg(F.sum(F.col("p_partkey") % 7 + 1.0).alias("weight"))
    centres = spectral.band_centres(spectral.check_weights(weights, 5))
    return centres.select("band", F.round("centre", 6).alias("centre"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each hour and kind by the windows that a stream has."""
    got = incremental.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")
    return got.select(F.col("window.start").alias("start"), "event_type", "n")


@query("""
WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN [c_custkey, c_custkey + 7] ELSE [] END AS refs, c_custkey * 3 AS own FROM customer), r AS (SELECT p_partkey FROM part), f AS (
  SELECT c_custkey, p_partkey, 1 AS k FROM (SELECT c_custkey, unnest(refs) AS ref FROM l) JOIN r ON p_partkey = ref WHERE p_partkey % 3 <> 0
  UNION ALL SELECT c_custkey, p_partkey, 2 FROM l JOIN r ON p_partkey = own WHERE p_partkey % 2 = 0), g AS (SELECT c_custkey, p_partkey, min(k) AS k FROM f GROUP BY ALL)
SELECT c_custkey, p_partkey, CASE k WHEN 1 THEN 'reference' WHEN 2 THEN 'same' ELSE 'none' END AS rule FROM l LEFT JOIN g USING (c_custkey)""")
def associated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that a row refers to, then those of its own specimen, each by the earlier rule; rows without any stay."""
    key = F.col("c_custkey")
    left = table(spark, sf_dir, "customer").select("c_custkey", F.when(key % 4 > 0, F.array(key.cast("string"), F.concat(F.lit(" "), (key + 7).cast("string")))).otherwise(F.array().cast("array<string>")).alias("refs"), F.concat(F.lit("LR-"), (key * 3).cast("string"), F.lit(" ")).alias("own"))
    part = F.col("p_partkey")
    right = table(spark, sf_dir, "part").select("p_partkey", F.when(part % 3 != 0, part.cast("string")).otherwise("").alias("lid"), F.when(part % 2 == 0, F.concat(F.lit("lr-"), part.cast("string"))).alias("specimen"))
    return joins.associated(left, right, "c_custkey", "refs", "own", ["p_partkey"], "lid", "specimen")


@query("""
WITH e AS (SELECT l_partkey AS id, l_quantity AS value, 'exact' AS kind, min(l_orderkey) AS source FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), p AS (SELECT l_partkey AS id, l_quantity AS value, 'parent' AS kind, max(l_suppkey) AS source FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL)
SELECT * FROM p UNION ALL SELECT * FROM e ANTI JOIN p USING (id, value)""")
def overwritten_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact claims and those of the parent; of an equal key the parent's."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("value"), "l_returnflag", "l_orderkey", "l_suppkey")
    exact = rows.where("l_returnflag = 'A'").groupBy("id", "value").agg(F.lit("exact").alias("kind"), F.min("l_orderkey").alias("source"))
    parent = rows.where("l_returnflag <> 'A'").groupBy("id", "value").agg(F.lit("parent").alias("kind"), F.max("l_suppkey").alias("source"))
    return joins.overwritten(exact, parent, ["id", "value"])


@query("SELECT s_nationkey AS parent, s_suppkey, c_custkey FROM supplier JOIN customer ON c_nationkey = s_nationkey WHERE c_custkey % 3 = 0")
def pairs_of_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of two archives with one parent, where the viewing geometry is the standard one."""
    left = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("parent"), "s_suppkey")
    right = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("parent"), "c_custkey")
    angle = F.when(F.col("c_custkey") % 3 == 0, 30.0).otherwise(F.when(F.col("c_custkey") % 3 == 1, 10.0))
    return joins.parent_pairs(left, right, "parent", F.coalesce(numeric.standard_geometry(angle, F.lit(0.0), angle), F.lit(False))).select("parent", "s_suppkey", "c_custkey")


@query("""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Sample ' || page_id WHEN 1 THEN 'Full Catalogue' ELSE 'Notes' END AS text, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || CASE page_id % 3 WHEN 0 THEN '/compendium/' || page_id || '.PDF?v=2' WHEN 1 THEN '/c.pdf' ELSE '/n.pdf' END AS absolute,
  CASE page_id % 3 WHEN 0 THEN 'compendium' WHEN 1 THEN 'catalog' ELSE 'other' END AS kind FROM pages""")
def document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages to documents of one ending, with their texts and kinds."""
    key = F.col("page_id").cast("string")
    more = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<a href='/compendium/"), key, F.lit(".PDF?v=2'>Sample <b>"), key, F.lit("</b></a>"))).when(F.col("page_id") % 3 == 1, '<a class="x" href="/c.pdf">Full\n Catalogue</a><a href="/pdf.html">no</a>').otherwise('<a href="/n.pdf">Notes')
    pages = table(spark, sf_dir, "pages").withColumn("html", F.concat("html", more))
    return documents.document_links(pages, "page_id", "url", "html").drop("pos")
