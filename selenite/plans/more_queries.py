"""Further queries over the driver's tables: links, texts, sets and small reports, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selenite.functions import numeric, text
from selenite.operators import aggregates, documents, joins, sequences, spectral
from selenite.sources import readers, sinks

from .queries import _r, query, table


@query("""
WITH n AS (SELECT p_partkey, p_size, p_partkey % 8 AS form, CAST([10, 11, 12, 13, 14, 15, 24, 61, 68, 70, 79, 80][p_partkey % 12 + 1] AS VARCHAR) AS two, lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS three FROM part),
k AS (SELECT *, form = 4 AS away, two IN ('10', '12', '14', '15', '61', '68', '70', '79') AND form <> 7 AS fits FROM n)
SELECT p_partkey, CASE WHEN away THEN 'outside' WHEN fits THEN 'known' ELSE 'unparsed' END AS scope, CASE WHEN fits AND NOT away THEN two || three END AS parent,
  CASE WHEN fits AND NOT away THEN two || three || CASE WHEN form IN (1, 2, 3) THEN ',' || p_size WHEN form = 6 THEN ',A-' || p_size ELSE '' END END AS normalized,
  fits AND NOT away AND form IN (1, 2, 3, 5, 6) AS has_context,
  CASE WHEN fits AND NOT away THEN CASE two WHEN '10' THEN 'Apollo 11' WHEN '61' THEN 'Apollo 16' WHEN '68' THEN 'Apollo 16' WHEN '70' THEN 'Apollo 17' WHEN '79' THEN 'Apollo 17' ELSE 'Apollo ' || two END END AS mission FROM k""")
def sample_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample numbers in the forms that names have: plain, with suffixes, grouped, of another programme, of no mission, too long."""
    two = F.element_at(F.array(*(F.lit(str(x)) for x in (10, 11, 12, 13, 14, 15, 24, 61, 68, 70, 79, 80))), (F.col("p_partkey") % 12 + 1).cast("int"))
    three, size = F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.col("p_size").cast("string")
    forms = [F.concat(two, three), F.concat(two, three, F.lit(","), size), F.concat(two, F.lit(" , "), three, F.lit(","), size), F.concat(two, three, F.lit("."), size, F.lit(" <150 um")), F.concat(F.lit("Luna 24, "), two, three), F.concat(two, three, F.lit(" bulk 125-250 um")), F.concat(F.lit("chip "), two, three, F.lit(";A-"), size), F.concat(two, three, F.lit("7"))]
    name = F.element_at(F.array(*forms), (F.col("p_partkey") % 8 + 1).cast("int"))
    found = table(spark, sf_dir, "part").select("p_partkey", text.sample_reference(name).alias("s"))
    return found.select("p_partkey", "s.scope", "s.parent", "s.normalized", "s.has_context", text.mission_of(F.col("s.parent")).alias("mission"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '<' WHEN c_acctbal > 5000 THEN '~' END AS qualifier, round(abs(c_acctbal), 2) AS value FROM customer")
def qualified_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("c_acctbal") < 0, "< ").when(F.col("c_acctbal") > 5000, "~").otherwise("")
    cell = F.concat(sign, F.format_string("%.2f", F.round(F.abs("c_acctbal"), 2)))
    return table(spark, sf_dir, "customer").select("c_custkey", text.qualified(cell).alias("q")).select("c_custkey", "q.qualifier", _r(F.col("q.value"), 2).alias("value"))


@query("""
WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[0-9]{2,3}')) AS ids FROM documents)
SELECT doc_id, unnest(ids) AS id, len(ids) > 1 AS needs_review FROM t""")
def multi_id_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per id that a document lists; more than one puts all under review."""
    ids = F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]{2,3}"), F.lit(0)))
    return table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids")).select("doc_id", F.explode("ids").alias("id"), (F.size("ids") > 1).alias("needs_review"))


@query("""
WITH c AS (SELECT o_custkey, min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey, round(low, 2) AS low, round(high, 2) AS high, coalesce(n, 0) AS n FROM customer LEFT JOIN c ON c_custkey = o_custkey""")
def enriched_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range and number of values per catalogue entry; entries without any have 0."""
    stats = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.count(F.lit(1)).alias("n"))
    out = table(spark, sf_dir, "customer").select("c_custkey").join(stats, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", _r(F.col("low"), 2).alias("low"), _r(F.col("high"), 2).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT l_suppkey, 'quantity' AS target, round(avg(l_quantity), 6) AS mean, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey, 'tax', round(avg(l_tax), 6), count(*) FROM lineitem GROUP BY 1")
def two_target_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two targets out of each source row."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"))
    return rows.unpivot(["l_suppkey"], ["quantity", "tax"], "target", "v").groupBy("l_suppkey", "target").agg(_r(F.avg("v")).alias("mean"), F.count("v").alias("n"))


@query("""
SELECT l_partkey, l_returnflag, count(DISTINCT l_orderkey) AS n_orders, min(l_orderkey) AS stable_id, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ';' ORDER BY CAST(l_suppkey AS VARCHAR)) AS suppliers FROM lineitem GROUP BY 1, 2""")
def inverse_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with all the measurements that they are linked to."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.countDistinct("l_orderkey").alias("n_orders"), F.min("l_orderkey").alias("stable_id"), aggregates.joined_set(F.col("l_suppkey")).alias("suppliers"))


@query("""
WITH s AS (SELECT l_orderkey, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag <> 'A') AS b FROM lineitem GROUP BY 1)
SELECT CASE WHEN a AND b THEN 'mixed' WHEN a THEN 'direct' ELSE 'parent' END AS scope, count(*) AS n FROM s GROUP BY 1""")
def relationship_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_returnflag") != "A").alias("b"))
    scope = F.when(F.col("a") & F.col("b"), "mixed").when(F.col("a"), "direct").otherwise("parent")
    return kinds.groupBy(scope.alias("scope")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id FROM events GROUP BY user_id HAVING NOT bool_or(event_type = 'error' AND value > 200)")
def groups_without_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users none of whose events is of the kind."""
    hit = (F.col("event_type") == "error") & (F.col("value") > 200)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(hit).alias("any")).where(~F.col("any")).select("user_id")


@query("(SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "k")
    both = rows.where("l_returnflag = 'A'").select("k").intersect(rows.where("l_returnflag = 'R'").select("k"))
    return joins.uncovered(both, rows.where("l_quantity > 48").select("k"), ["k"])


@query("SELECT source || chr(9) || string_agg(DISTINCT CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR)) AS value FROM documents GROUP BY source")
def task_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.task_lines(table(spark, sf_dir, "documents"), "source", "doc_id")


@query("SELECT n_nationkey, 'n_name: ' || n_name || ' | n_regionkey: ' || n_regionkey AS line FROM nation")
def row_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return rows.select("n_nationkey", text.row_text(rows, ["n_nationkey"]).alias("line"))


@query('SELECT \'labels\' AS "table", count(*) AS n_rows FROM labels UNION ALL SELECT \'pages\', count(*) FROM pages UNION ALL SELECT \'documents\', count(*) FROM documents')
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.status_report({n: table(spark, sf_dir, n) for n in ("labels", "pages", "documents")})


@query("""
WITH m AS (SELECT l_suppkey, month(l_shipdate) AS x, avg(l_quantity) AS y FROM lineitem GROUP BY 1, 2), b AS (SELECT *, max(y) FILTER (x = 6) OVER (PARTITION BY l_suppkey) AS base FROM m)
SELECT l_suppkey, CAST(x AS INT) AS x, round(CASE WHEN abs(base) >= 1e-12 THEN y / base END, 6) AS normalized FROM b""")
def normalized_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.month("l_shipdate").alias("x")).agg(F.avg("l_quantity").alias("y"))
    return spectral.normalized_at(rows, ["l_suppkey"], "x", "y", 6).select("l_suppkey", "x", _r(F.col("normalized")).alias("normalized"))


@query("SELECT n_nationkey, to_json({'name': n_name, 'region': n_regionkey})::VARCHAR AS extra FROM nation")
def json_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("extra"))


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey, s_acctbal DESC, s_suppkey) AS id FROM supplier")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in a total order, without a sort in one task."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return sequences.numbered(rows, "s_nationkey", [F.desc("s_acctbal"), F.asc("s_suppkey")]).select("s_suppkey", "id")


@query("SELECT count(*) AS n, count(*) FILTER (l_discount > 0.05) AS n_discounted, count(*) FILTER (l_returnflag = 'R' AND l_tax = 0) AS n_untaxed_returns FROM lineitem")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("n_discounted"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_tax") == 0)).alias("n_untaxed_returns"))


@query("SELECT l_orderkey, l_linenumber, l_quantity BETWEEN 29.99 AND 30.01 AND abs(l_discount) <= 0.01 AND l_quantity BETWEEN 29.99 AND 30.01 AS standard FROM lineitem")
def standard_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numeric.standard_geometry(F.col("l_quantity"), F.col("l_discount"), F.col("l_quantity")).alias("standard"))


@query("SELECT conv_id, string_agg(role || ': ' || length(text), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def text_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.lit(": "), F.length("text").cast("string")).alias("line"))
    return sinks.report(rows, ["conv_id"], "turn", "line")


@query("SELECT page_id, CASE WHEN html LIKE '%</footer>%' THEN 'found' ELSE 'missing' END AS status, CASE WHEN html LIKE '%</footer>%' THEN '</footer>' END AS value FROM pages")
def single_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", text.matched_once(F.col("html"), "(</footer>)").alias("m"))
    return found.select("page_id", "m.status", "m.value")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents)
SELECT doc_id, count(*) AS n_lines, count(DISTINCT content) AS n_distinct FROM l GROUP BY doc_id""")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sequences.lines_of(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("content").alias("n_distinct"))


@query("""
WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS pos FROM conversations)
SELECT conv_id, turn, string_agg(word, ' ' ORDER BY pos) AS row_text FROM w GROUP BY 1, 2""")
def word_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with places put together to rows again."""
    words = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("block"), F.lit(0).alias("line"), F.posexplode(F.split("text", " ")).alias("x0", "text"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("y1"))
    return documents.word_rows(words, ["conv_id"]).select("conv_id", F.col("block").alias("turn"), "row_text")


@query("SELECT lang AS source, sha256(max(text)) AS sha256, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY lang")
def digests_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the greatest text of each language."""
    rows = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("source"))
    return rows.agg(F.sha2(F.max("text"), 256).alias("sha256"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT name, unit_nm FROM (VALUES ('a', 1500.0::DOUBLE), ('b', 250.0::DOUBLE), ('c', 50.0::DOUBLE)) t(name, unit_nm)")
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("a", 1.5, "um"), ("b", 250.0, "NM"), ("c", 500.0, "angstrom")], "name string, v double, unit string")
    return rows.select("name", numeric.to_nanometres(F.col("v"), F.col("unit")).alias("unit_nm"))


@query(r"""
WITH p AS (SELECT page_id, regexp_extract_all(html, '<p>([^<]*)</p>', 1) AS ps FROM pages), x AS (SELECT page_id, array_to_string(ps, chr(12)) || chr(12) || ' ' AS t, len(ps) AS n FROM p)
SELECT page_id, CAST(i AS INT) AS page, length(s) AS n_chars FROM (SELECT page_id, n, unnest(string_split(t, chr(12))) AS s, unnest(range(1, len(string_split(t, chr(12))) + 1)) AS i FROM x) WHERE i <= greatest(n, 1)""")
def form_feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of text between form feeds; a blank last one is none."""
    joined = F.concat(F.array_join(F.regexp_extract_all("html", F.lit("<p>([^<]*)</p>"), F.lit(1)), "\f"), F.lit("\f "))
    rows = table(spark, sf_dir, "pages").select("page_id", joined.alias("t"))
    return readers.ocr_pages(rows, "page_id", "t").select("page_id", "page", F.length("text").cast("long").alias("n_chars"))
