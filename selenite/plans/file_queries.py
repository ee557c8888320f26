"""Queries that write the driver's tables in the formats of the readers and read them again, each beside its SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selenite.functions import text
from selenite.sources import readers, sinks
from selenite.sources.scratch import new_path

from .queries import _r, query, table


def _content(key: str, content: Column, scheme: str = "mem") -> list[Column]:
    """(path, content) as the binary source gives them."""
    return [F.concat(F.lit(f"{scheme}://h/"), F.col(key).cast("string")).alias("path"), F.encode(content, "UTF-8").alias("content")]


def _key(path: str = "path") -> Column:
    return F.regexp_extract(path, "([0-9]+)[^/0-9]*$", 1).cast("long")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(CASE WHEN c_nationkey % 5 = 0 THEN -99 ELSE c_nationkey END AS VARCHAR) AS nation, 'say \"' || c_mktsegment || '\", twice' AS note FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table through the CSV sink, nulls as a sentinel, and back, with its columns required; quotes and commas in cells."""
    path = new_path(spark, "csv")
    nation = F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey"))
    rows = table(spark, sf_dir, "customer").withColumn("nation", nation).withColumn("note", F.concat(F.lit('say "'), "c_mktsegment", F.lit('", twice')))
    sinks.refuse_existing(spark, [path], overwrite=False)
    sinks.write_csv(rows, path, ["c_custkey", "c_name", "nation", "note"], sentinels={"nation": -99})
    return readers.csv_table(spark, path, ["c_custkey", "note"])


@query("SELECT 'there' AS name, count(*) AS n, true AS found FROM supplier UNION ALL SELECT 'absent', 0, false")
def optional_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An optional table that is there and one that is not: the absent one is empty, with the same columns."""
    path = new_path(spark, "optional")
    sinks.write_csv(table(spark, sf_dir, "supplier"), path, ["s_suppkey", "s_name"])
    schema = T._parse_datatype_string("s_suppkey long, s_name string, added double")
    parts = [(name, *readers.optional_table(spark, p, schema)) for name, p in (("there", path), ("absent", f"{path}-absent"))]
    there, absent = (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n", F.lit(found).alias("found")) for name, df, found in parts)
    return there.unionByName(absent)


@query("""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) + 1 AS source_row FROM supplier)
SELECT s_name AS name, CAST(s_suppkey AS VARCHAR) AS code, CASE WHEN s_suppkey % 3 = 0 THEN format('csv-row-{:06d}', source_row) ELSE 'S' || s_suppkey END AS id, source_row, CAST(NULL AS VARCHAR) AS grain FROM s""")
def sniffed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of an unknown dialect, one a nation: separator and columns are found, missing ids are the rows' numbers."""
    path = new_path(spark, "sniffed")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("Specimen Name"), F.col("s_suppkey").alias("Lab-Code"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("S"), "s_suppkey")).alias("Spectrum ID"), "s_nationkey")
    rows.repartition("s_nationkey").sortWithinPartitions("s_nationkey", "Lab-Code").write.partitionBy("s_nationkey").option("header", True).option("sep", ";").csv(path)
    return readers.sniffed_table(spark, path, {"name": ["specimen_name"], "code": ["lab code"], "id": ["spectrumid"], "grain": ["grain size"]}, ["name", "id"], "id")


_LABEL = """<?xml version="1.0"?><p:Product xmlns:p="urn:x"><p:logical_identifier>urn:lab:n%d</p:logical_identifier><p:version_id>1.%d</p:version_id><p:title>  %s
 table </p:title><p:specimen_name>%s</p:specimen_name><p:lid_reference>urn:r:%d</p:lid_reference><p:File><p:file_name>n%d.tab</p:file_name></p:File></p:Product>"""


@query("""
SELECT 'urn:lab:n' || n_nationkey AS identifier, '1.' || n_regionkey AS version, n_name || ' table' AS title, n_name AS specimen_name, 'n' || n_nationkey || '.tab' AS file_name, 'urn:r:' || n_regionkey AS reference, false AS broken FROM nation WHERE n_nationkey % 7 <> 3
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, true FROM nation WHERE n_nationkey % 7 = 3""")
def label_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identification and references of XML labels with a namespace; a broken label is a row with its error, and stops none."""
    path = new_path(spark, "labels")
    label = F.format_string(_LABEL, "n_nationkey", "n_regionkey", "n_name", "n_name", "n_regionkey", "n_nationkey")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 7 == 3, F.substring(label, 1, 100)).otherwise(label).alias("value"))
    rows.repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    got = readers.labels(readers.files(spark, path, "part-*"))
    return got.select("identifier", "version", "title", "specimen_name", "file_name", F.get("references", F.lit(0)).alias("reference"), F.col("error").isNotNull().alias("broken"))


@query("""
SELECT o_custkey AS custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS point, CAST(o_orderkey AS DOUBLE) AS x, CAST(length(o_orderpriority) AS DOUBLE) / 4 AS y, false AS broken FROM orders WHERE o_custkey % 10 <> 7
UNION ALL SELECT DISTINCT o_custkey, NULL, NULL, NULL, true FROM orders WHERE o_custkey % 10 = 7""")
def fixed_width_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of fixed width as their labels place them, below a line and above a footer; a table that is cut short is an error."""
    record = F.format_string("%9d%7.2f\r\n", "o_orderkey", F.length("o_orderpriority") / 4)
    files = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", record.alias("r")))), lambda x: x["r"]), "").alias("body"), F.count(F.lit(1)).alias("records"))
    cut = F.when(F.col("o_custkey") % 10 == 7, F.expr("left(body, length(body) - 5)")).otherwise(F.concat("body", F.lit("end of table")))
    name = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(".tab")).alias("file_name")
    fields = F.from_json(F.lit('[{"name":"x","number":1,"location":1,"length":9,"unit":"nm"},{"name":"y","number":2,"location":10,"length":7}]'), "array<struct<name:string,number:int,location:int,length:int,unit:string>>")
    tables = files.select(name, F.encode(F.concat(F.lit("5\r\n"), cut), "UTF-8").alias("content"))
    labelled = files.select(name, F.lit(3).cast("long").alias("table_offset"), "records", F.lit(18).cast("long").alias("record_length"), fields.alias("fields"))
    got = readers.fixed_width_points(tables, labelled)
    return got.select(_key("file_name").alias("custkey"), "point", F.get("values", F.lit(0)).alias("x"), F.get("values", F.lit(1)).alias("y"), F.col("error").isNotNull().alias("broken"))


@query("""
SELECT n_regionkey AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS "row", n_name AS specimen_id, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) END AS feo_percent, false AS broken FROM nation WHERE n_regionkey <> 2
UNION ALL SELECT 2, NULL, NULL, NULL, true""")
def delimited_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited tables whose columns the labels name; blank cells are absent, and a table of other columns is an error."""
    line = F.concat(F.col("n_name"), F.lit(","), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("string")).otherwise(""))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda x: x["line"]), "\n")
    head = F.when(F.col("n_regionkey") == 2, "Specimen ID").otherwise("Specimen ID,FeO (Percent)")
    files = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(body.alias("body"))
    got = readers.delimited_by_label(files.select(*_content("n_regionkey", F.concat_ws("\n", head, "body"))), ["Specimen ID", "FeO (Percent)"])
    return got.select(_key().cast("int").alias("region"), "row", F.col("cells")["Specimen_ID"].alias("specimen_id"), F.col("cells")["FeO_Percent"].alias("feo_percent"), F.col("error").isNotNull().alias("broken"))


@query("""
WITH p AS (SELECT o_custkey, o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN (o_orderkey % 49) / 4.0 ELSE o_orderkey % 900 + 50.0 END AS x, length(o_orderpriority) / 2.0 AS y FROM orders WHERE o_orderkey % 5 <> 0),
k AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, max(x) OVER (PARTITION BY o_custkey) AS most FROM p)
SELECT o_custkey, o_orderkey, CAST(CASE WHEN most < 50 THEN x * 1000 ELSE x END AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM k WHERE n >= 2""")
def ascii_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-column texts below their header line, whatever separates the columns; micrometres become nanometres."""
    x = F.when(F.col("o_custkey") % 2 == 0, (F.col("o_orderkey") % 49) / 4.0).otherwise(F.col("o_orderkey") % 900 + 50.0)
    mark = F.element_at(F.array(F.lit(" "), F.lit(", "), F.lit(";"), F.lit("\t")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    line = F.when(F.col("o_orderkey") % 5 == 0, "no data").otherwise(F.concat(F.lit("  "), x.cast("string"), mark, (F.length("o_orderpriority") / 2.0).cast("string")))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", line.alias("t"))
    heads = orders.select("o_custkey").distinct().select("o_custkey", F.explode(F.array(F.struct(F.lit(-2).cast("long").alias("o_orderkey"), F.lit("1.0 2.0").alias("t")), F.struct(F.lit(-1).cast("long").alias("o_orderkey"), F.lit("WAVELENGTH  reflectance").alias("t")))).alias("h")).select("o_custkey", "h.*")
    return readers.ascii_curve(orders.unionByName(heads), "o_custkey", "o_orderkey", "t").select("o_custkey", "o_orderkey", "x", "y")


@query("""
WITH e AS (SELECT vec_id, unnest(embedding) AS w, generate_subscripts(embedding, 1) AS k FROM embeddings)
SELECT vec_id, 350 + 0.5 * CAST((k - 1) // 8 AS DOUBLE) AS axis, CAST((k - 1) % 8 + 1 AS INT) AS band, CAST(w AS DOUBLE) AS weight FROM e""")
def float_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Little-endian matrices of 32-bit numbers, a row per axis point and a column per band."""

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": "mem://h/" + frame["vec_id"].astype(str), "content": [np.asarray(v, "<f4").tobytes() for v in frame["embedding"]]})

    files = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select("vec_id", "embedding").mapInPandas(packed, "path string, content binary")
    return readers.float_matrix(files, 8, 350.0, 0.5).select(_key().alias("vec_id"), "axis", "band", "weight")


@query("SELECT n_regionkey AS region, CAST(n_nationkey + 10000 AS VARCHAR) AS sample, n_name || ' inner' AS kind, 'http://h/d/' || n_nationkey || '.html' AS link FROM nation")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the outer tables of pages below their header, each id once, links against the page; text of an inner table is its cell's, totals are no ids."""
    row = F.format_string("<tr><td><a href='../d/%d.html'>%d</a></td><td> %s <table><tr><td>inner</td></tr></table></td></tr>", "n_nationkey", F.col("n_nationkey") + 10000, "n_name")
    body = F.array_join(F.array_sort(F.collect_list(row)), "")
    pages = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(body.alias("b"))
    page = F.concat(F.lit("<p>List</p><table><tr><td>of samples</td></tr><tr><th>Sample</th><th>Rock Type</th></tr>"), "b", "b", F.lit("<tr><td>total</td><td>2</td></tr></table>"))
    got = readers.html_table(pages.select(F.concat(F.lit("http://h/list/"), F.col("n_regionkey").cast("string")).alias("path"), F.encode(page, "UTF-8").alias("content")), ["Sample", "Rock Type"], "[0-9]{5}", strict=True)
    return got.select(_key().cast("int").alias("region"), F.col("cells")["Sample"].alias("sample"), F.col("cells")["Rock Type"].alias("kind"), "link")


_TURNS = "SELECT conv_id, turn, role, md5(text) AS digest, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS place FROM conversations"


@query(f"""
WITH t AS ({_TURNS}) SELECT role, CASE WHEN turn <> 3 THEN conv_id END AS conv_id, CASE WHEN turn <> 3 THEN turn END AS turn, CASE WHEN turn <> 3 THEN digest END AS digest, CASE WHEN turn = 3 THEN 2 * place END AS line FROM t""")
def json_line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns through JSON lines and back, one file a role, a blank line before each; broken lines come with file and line."""
    path = new_path(spark, "jsonl")
    whole = F.to_json(F.struct("role", "conv_id", "turn", "text"))
    rows = table(spark, sf_dir, "conversations").withColumn("value", F.concat(F.lit("\n"), F.when(F.col("turn") == 3, F.expr("left(to_json(struct(role, conv_id, turn, text)), 12)")).otherwise(whole)))
    rows.select("role", "conv_id", "turn", "value").repartition("role").sortWithinPartitions("role", "conv_id", "turn").select("role", "value").write.partitionBy("role").text(path)
    fine, broken = readers.json_lines(spark, path, "role string, conv_id long, turn long, text string")
    fine = fine.select("role", "conv_id", "turn", F.md5(F.encode("text", "UTF-8")).alias("digest"), F.lit(None).cast("long").alias("line"))
    return fine.unionByName(broken.select(F.regexp_extract("file", "role=([^/]*)", 1).alias("role"), F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("digest"), "line"))


@query("SELECT n_regionkey AS region, n_nationkey AS page_number, n_name AS page_text FROM nation")
def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nested JSON, a compressed file each, to a row per page."""
    path = new_path(spark, "nested")
    page = F.struct(F.col("n_nationkey").alias("page_number"), F.col("n_name").alias("text"))
    docs = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    docs.select("n_regionkey", F.to_json(F.struct(F.struct(F.col("n_regionkey").alias("document_id")).alias("source"), "pages")).alias("value")).repartition("n_regionkey").write.partitionBy("n_regionkey").option("compression", "gzip").text(path)
    got = readers.nested_json(spark, path, "source struct<document_id:int>, pages array<struct<page_number:int,text:string>>")
    return got.select(F.col("source.document_id").alias("region"), F.explode("pages").alias("p")).select("region", "p.page_number", F.col("p.text").alias("page_text"))


@query("""
WITH p AS (SELECT p_partkey // 16 AS line, CAST(row_number() OVER (PARTITION BY p_partkey // 16 ORDER BY p_partkey) - 1 AS INT) AS sample, p_size FROM part)
SELECT line, sample, CAST(p_size AS DOUBLE) AS b1, CAST(p_size * 2 AS DOUBLE) AS b2, CAST(p_size * 3 AS DOUBLE) AS b3, CAST(p_size * 2.5 AS DOUBLE) AS feo, CAST(p_size % 4 AS SMALLINT) AS flags, CAST(line // 256 AS INT) AS block FROM p""")
def raster_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band images of equal shape to a spectrum a pixel, and typed layers of it written by blocks of lines and read again."""
    path = new_path(spark, "layers")
    sizes = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 16).alias("line"), "p_partkey", "p_size", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("band"))
    row = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", (F.col("p_size") * F.col("band")).cast("string").alias("v")))), lambda x: x["v"])
    cube = readers.raster_cube(sizes.groupBy("line", "band").agg(F.array_join(row, "\t").alias("text")), 3)
    layers = cube.select("line", F.col("column").alias("sample"), *(F.get("spectrum", F.lit(k)).alias(f"b{k + 1}") for k in range(3)))
    layers = layers.withColumn("feo", F.col("b1") * 2.5).withColumn("flags", F.col("b1") % 4)
    sinks.write_layers(layers, path, "line", {"b1": "double", "b2": "double", "b3": "double", "feo": "double", "flags": "short"})
    return spark.read.parquet(path).select("line", "sample", "b1", "b2", "b3", "feo", "flags", "block")


@query("SELECT n_nationkey, sha256(n_name || chr(10)) AS sha256 FROM nation")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of whole files."""
    path = new_path(spark, "digests")
    table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    return sinks.digests(readers.files(spark, path, "part-*")).select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey"), "sha256")


@query("""
SELECT 'rows:orders' AS entry, CAST((SELECT count(*) FROM orders) AS VARCHAR) AS value UNION ALL SELECT 'rows:customer', CAST((SELECT count(*) FROM customer) AS VARCHAR)
UNION ALL SELECT 'parameter:least', '0.5' UNION ALL SELECT 'warnings', (SELECT string_agg(n_name, ';' ORDER BY n_name) FROM (SELECT n_name FROM nation ORDER BY n_name LIMIT 3)) UNION ALL SELECT 'digests', '25'""")
def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of a run as rows: counts of its tables, parameters, the first warnings, how many files have digests."""
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("warning"))
    files = table(spark, sf_dir, "nation").select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("path"), F.sha2("n_name", 256).alias("sha256"))
    row = sinks.manifest(spark, {t: table(spark, sf_dir, t) for t in ("orders", "customer")}, {"least": "0.5"}, names, most=3, files=files)
    entries = F.concat(
        F.transform(F.map_entries("counts"), lambda e: F.struct(F.concat(F.lit("rows:"), e["key"]).alias("entry"), e["value"].cast("string").alias("value"))),
        F.transform(F.map_entries("parameters"), lambda e: F.struct(F.concat(F.lit("parameter:"), e["key"]).alias("entry"), e["value"].alias("value"))),
        F.array(F.struct(F.lit("warnings").alias("entry"), F.array_join("warnings", ";").alias("value")), F.struct(F.lit("digests").alias("entry"), F.size("sha256").cast("string").alias("value"))),
    )
    return row.select(F.explode(entries).alias("e")).select("e.*")


@query("""
WITH s AS (SELECT l_suppkey, l_linenumber, avg(l_quantity) AS m, stddev_samp(l_quantity) AS sd FROM lineitem GROUP BY ALL)
SELECT CAST(l_suppkey AS VARCHAR) AS series, l_linenumber AS x, round(m, 6) AS y, round(m - coalesce(sd, 0), 6) AS low, round(m + coalesce(sd, 0), 6) AS high FROM s""")
def plot_ribbons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tidy data of a plot of means with their deviations."""
    stats = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("sd"))
    return sinks.ribbon(stats, "l_suppkey", "l_linenumber", "m", "sd").select("series", "x", *(_r(F.col(c)).alias(c) for c in ("y", "low", "high")))


@query("""
SELECT p_partkey, ['wavelength', 'reflectance', 'uncertainty', 'uncertainty', 'wavelength', NULL][p_partkey % 6 + 1] AS role FROM part""")
def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of spectral columns by the words in their names."""
    names = ("Wavelength (nm)", "Bidirectional REFLECTANCE", "Standard Deviation", "Reflectance error", "wave number", "comment")
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", readers.field_role(name).alias("role"))


@query("SELECT c_custkey, c_name AS name FROM customer")
def header_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue whose columns are required, its name from the first column there is of several."""
    rows = text.require_columns(table(spark, sf_dir, "customer"), ["c_custkey", "c_nationkey"], "catalogue")
    return rows.select("c_custkey", F.col(text.first_column(rows, ["sample_name", "c_name", "c_mktsegment"])).alias("name"))


@query("""
WITH m AS (SELECT s_suppkey % 40 AS id, s_suppkey, s_name FROM supplier WHERE s_suppkey % 5 NOT IN (1, 2))
SELECT CAST(id AS VARCHAR) AS measurement_id, s_name AS specimen_name, 'S' || s_suppkey || '.TAB' AS table_file, count(*) OVER (PARTITION BY id) > 1 AS duplicate FROM m""")
def measurement_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of measurements among other labels, ids that come again marked; labels without a range are none."""
    kind = F.when(F.col("s_suppkey") % 5 == 1, "data_chemistry").otherwise("data_reflectance")
    span = F.when(F.col("s_suppkey") % 5 == 2, "").otherwise("<spectral_range_min>300</spectral_range_min><spectral_range_max>2600</spectral_range_max>")
    label = F.format_string("<a><logical_identifier>urn:%s:%d:</logical_identifier><specimen_name>%s</specimen_name>%s<file_name>x.csv</file_name><file_name>S%d.TAB</file_name></a>", kind, F.col("s_suppkey") % 40, "s_name", span, "s_suppkey")
    found, again = readers.measurements(readers.labels(table(spark, sf_dir, "supplier").select(*_content("s_suppkey", label))))
    marked = found.join(again, "measurement_id", "left")
    return marked.select("measurement_id", "specimen_name", "table_file", F.col("n").isNotNull().alias("duplicate"))
