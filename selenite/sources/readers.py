"""Readers of the formats that laboratory archives use. Files are opened by Spark alone, so any store it knows will do.

Whole-file formats go through the binary source and are decoded per file: a bad file gives a row in `error` and never
stops the others, unless strict is asked for.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selenite.functions.text import clean, normalized_key, require_columns


def csv_table(spark: SparkSession, path: str, needed: Sequence[str] = (), separator: str = ",") -> DataFrame:
    """A delimited file with a header, all cells as text; a BOM is stripped, blanks are null."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', sep=separator, encoding="UTF-8")
    return require_columns(df, needed, path)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def optional_table(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, bool]:
    """The table and whether it is there; one that isn't is empty."""
    if exists(spark, path):
        df = csv_table(spark, path)
        return df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema)), True
    return spark.createDataFrame([], schema), False


def sniffed_table(spark: SparkSession, path: str, aliases: dict[str, Sequence[str]], needed: Sequence[str], id_column: str) -> DataFrame:
    """A delimited file of unknown dialect: the separator is the one of `,`, tab, `;` and `|` that the head uses most evenly.

    Columns are found by normalised header names among their aliases; a missing id is the row's number, and
    source_row has the row's number in its file. Rows are numbered where they are read, a file being one split.
    """
    head = spark.read.text(path).limit(20).collect()
    lines = [r.value.lstrip("﻿") for r in head if r.value]
    if not lines:
        raise ValueError(f"no header row in {path}")
    score = {s: (min(x.count(s) for x in lines), lines[0].count(s)) for s in ",\t;|"}
    separator = max(score, key=lambda s: score[s]) if max(score.values()) > (0, 0) else "\t" if path.lower().endswith(".tsv") else ","
    df = csv_table(spark, path, separator=separator)
    known = {re.sub("[^a-z0-9]+", "", c.lower()): c for c in df.columns}
    chosen = {t: next((known[a] for a in (re.sub("[^a-z0-9]+", "", x.lower()) for x in (t, *names)) if a in known), None) for t, names in aliases.items()}
    if missing := [t for t in needed if chosen.get(t) is None]:
        raise ValueError(f"{path} has no column for: {', '.join(missing)}")
    rows = df.select(*(clean(F.col(f"`{c}`")).alias(t) if c else F.lit(None).cast("string").alias(t) for t, c in chosen.items()), F.input_file_name().alias("__file"), F.monotonically_increasing_id().alias("__at"))
    begins = rows.groupBy("__file").agg(F.min("__at").alias("__begin"))
    rows = rows.join(begins, "__file").withColumn("source_row", F.col("__at") - F.col("__begin") + 2).drop("__file", "__at", "__begin")
    named = F.coalesce(F.nullif(F.col(id_column), F.lit("")), F.format_string("csv-row-%06d", F.col("source_row")))
    return rows.withColumn(id_column, named)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content, sha256) of every file below path."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return df.select("path", "content", F.sha2("content", 256).alias("sha256"))


def _decoded(df: DataFrame, decode, schema: str, strict: bool) -> DataFrame:
    """Rows of decode(path, content) for each file, with an error column."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    out += [[path, None, *(row.get(n) for n in names)] for row in decode(path, content)]
                except Exception as error:
                    if strict:
                        raise ValueError(f"{path}: {error}") from error
                    out.append([path, f"{type(error).__name__}: {error}", *[None] * len(names)])
            yield pd.DataFrame(out, columns=["path", "error", *names], dtype=object)

    return df.select("path", "content").mapInPandas(run, f"path string, error string, {schema}")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _label(path: str, content: bytes) -> list[dict]:
    root = ElementTree.fromstring(content)
    all_of = lambda name: [" ".join((e.text or "").split()) for e in root.iter() if _local(e.tag) == name and (e.text or "").strip()]
    first = lambda *names: next((x for n in names for x in all_of(n)), None)
    fields = []
    for e in root.iter():
        if _local(e.tag) in ("Field_Character", "Field_Delimited"):
            got = {_local(x.tag): (x.text or "").strip() for x in e}
            fields.append({"name": got.get("name"), "number": int(got.get("field_number") or len(fields) + 1), "location": int(got.get("field_location") or 0), "length": int(got.get("field_length") or 0), "unit": got.get("unit")})
    table = next((e for e in root.iter() if _local(e.tag) in ("Table_Character", "Table_Delimited")), None)
    part = lambda name: next((int(x.text) for x in table.iter() if _local(x.tag) == name), None) if table is not None else None
    return [{"identifier": first("logical_identifier"), "version": first("version_id"), "title": first("title"), "specimen_id": first("specimen_id"), "specimen_name": first("specimen_name"), "range_least": first("spectral_range_min"), "range_most": first("spectral_range_max"), "file_name": first("file_name"), "files": all_of("file_name"), "table_offset": part("offset"), "records": part("records"), "record_length": part("record_length"), "fields": fields, "references": list(dict.fromkeys(all_of("lid_reference")))}]


LABEL = "identifier string, version string, title string, specimen_id string, specimen_name string, range_least string, range_most string, file_name string, files array<string>, table_offset long, records long, record_length long, fields array<struct<name:string,number:int,location:int,length:int,unit:string>>, references array<string>"


def labels(df: DataFrame, strict: bool = False) -> DataFrame:
    """XML labels of files(path, content), whatever their namespaces: identification, file, table layout, references."""
    return _decoded(df, _label, LABEL, strict)


def measurements(labelled: DataFrame, part: str = "data_reflectance") -> tuple[DataFrame, DataFrame]:
    """Of labels, those of measurements, whose identifier has the part and which name a specimen and a spectral range, with
    the measurement's id and its table file; and the ids that come more than once, with their numbers."""
    known = labelled.where(F.contains("identifier", F.lit(part)) & F.col("specimen_name").isNotNull() & F.col("range_least").isNotNull() & F.col("range_most").isNotNull())
    name = F.element_at(F.split(F.regexp_replace("identifier", ":+$", ""), ":"), -1)
    found = known.select(name.alias("measurement_id"), F.get(F.filter("files", lambda x: F.lower(x).endswith(".tab")), F.lit(0)).alias("table_file"), *labelled.columns)
    return found, found.groupBy("measurement_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# Words that tell a spectral column's role.
ROLES = {"wavelength": ("wavelength", "wavenumber"), "uncertainty": ("standarddeviation", "stddev", "uncertainty", "error"), "reflectance": ("reflectance",)}


def field_role(name: Column) -> Column:
    key = normalized_key(name)
    out = F.lit(None).cast("string")
    for role, words in reversed(ROLES.items()):
        out = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(key, w)), role).otherwise(out)
    return out


def fixed_width_points(tables: DataFrame, labelled: DataFrame, key: str = "file_name") -> DataFrame:
    """(file_name, point, values, error) of fixed-width records as the labels place them; nothing is guessed.

    tables(file_name, content) and labels are joined on the file's name. Records are cut by offset and length, fields by
    location and length; a short file or a field that is no finite number is an error of that file.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                try:
                    need = row.table_offset + row.records * row.record_length
                    if len(row.content) < need:
                        raise ValueError(f"{len(row.content)} bytes, the label needs {need}")
                    text = row.content[row.table_offset : need].decode("ascii")
                    for p in range(row.records):
                        record = text[p * row.record_length : (p + 1) * row.record_length]
                        values = [float(record[f["location"] - 1 : f["location"] - 1 + f["length"]]) for f in row.fields]
                        if not np.isfinite(values).all():
                            raise ValueError(f"record {p} is not finite")
                        out.append((getattr(row, key), p, values, None))
                except Exception as error:
                    out = [x for x in out if x[0] != getattr(row, key)]
                    out.append((getattr(row, key), None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=[key, "point", "values", "error"], dtype=object)

    both = tables.select(key, "content").join(labelled.select(key, "table_offset", "records", "record_length", "fields"), key)
    return both.mapInPandas(run, f"{key} string, point long, values array<double>, error string")


def _rows_by_label(path: str, content: bytes, names: list[str], records: int | None) -> list[dict]:
    rows = list(csv.reader(io.StringIO(content.decode("utf-8-sig"))))
    head, body = rows[0], [r for r in rows[1:] if r]
    if len(head) != len(names):
        raise ValueError(f"{len(head)} columns, the label has {len(names)}")
    if records is not None and len(body) != records:
        raise ValueError(f"{len(body)} rows, the label has {records}")
    canonical = [re.sub("^_+|_+$", "", re.sub("[^A-Za-z0-9]+", "_", n)) for n in names]
    if len(set(canonical)) != len(canonical):
        raise ValueError("two columns have one name")
    if bad := next((k for k, r in enumerate(body) if len(r) != len(names)), None):
        raise ValueError(f"row {bad} has {len(body[bad])} cells")
    return [{"row": k, "cells": {n: c for n, c in zip(canonical, r, strict=True) if c.strip()}} for k, r in enumerate(body)]


def delimited_by_label(df: DataFrame, names: Sequence[str], records: int | None = None, strict: bool = False) -> DataFrame:
    """(path, row, cells) of delimited tables whose columns the label names; dynamic columns are a map."""
    return _decoded(df, lambda path, content: _rows_by_label(path, content, list(names), records), "row long, cells map<string,string>", strict)


def ascii_curve(lines: DataFrame, key: str, position: str, text: str, words: Sequence[str] = ("wavelength", "reflectance")) -> DataFrame:
    """(key, position, x, y) of two-column text below the line that holds both words; x below 50 everywhere is micrometres."""
    both = F.lit(True)
    for w in words:
        both &= F.contains(F.lower(text), F.lit(w))
    head = lines.where(both).groupBy(key).agg(F.min(position).alias("__head"))
    parts = F.split(F.trim(text), r"[\s,;]+")
    pairs = lines.join(head, key).where(F.col(position) > F.col("__head")).select(key, position, F.get(parts, F.lit(0)).try_cast("double").alias("x"), F.get(parts, F.lit(1)).try_cast("double").alias("y"))
    fine = pairs.where("x IS NOT NULL AND y IS NOT NULL AND abs(x) < double('inf') AND abs(y) < double('inf')")
    scale = fine.groupBy(key).agg(F.when(F.max("x") < 50, 1000.0).otherwise(1.0).alias("__scale"), F.count(F.lit(1)).alias("__n")).where("__n >= 2")
    return fine.join(scale, key).select(key, position, (F.col("x") * F.col("__scale")).alias("x"), "y")


def float_matrix(df: DataFrame, columns: int, start: float, step: float, strict: bool = True) -> DataFrame:
    """(path, axis, band, weight) of little-endian 32-bit matrices with a row per axis point and a column per band."""

    def decode(path: str, content: bytes) -> list[dict]:
        values = np.frombuffer(content, "<f4").astype(float).reshape(-1, columns)
        if not np.isfinite(values).all():
            raise ValueError("not finite")
        return [{"axis": start + k * step, "band": b + 1, "weight": float(values[k, b])} for k in range(len(values)) for b in range(columns)]

    return _decoded(df, decode, "axis double, band int, weight double", strict)


class _Table(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.depth, self.rows, self.cell, self.href = 0, [], None, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
        elif self.depth == 1 and tag == "tr":
            self.rows.append([])
        elif self.depth == 1 and tag in ("td", "th") and self.rows:
            self.cell, self.href = [], None
        elif tag == "a" and self.cell is not None and self.href is None:
            self.href = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth -= 1
        elif self.depth == 1 and tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append((" ".join(" ".join(self.cell).split()), self.href))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_rows(page: str, base: str, header: Sequence[str], id_pattern: str) -> list[dict]:
    """Rows of the outermost tables below a header found in the first ten rows; rows whose id doesn't match, and later ones of an id, are left out."""
    if re.search(r"(?i)captcha|access denied|are you a robot", page):
        raise ValueError("the page is a bot check")
    parser = _Table()
    parser.feed(page)
    key = lambda x: re.sub("[^a-z0-9]+", "", x.lower())
    head = next((k for k, r in enumerate(parser.rows[:10]) if {key(h) for h in header} <= {key(c) for c, _ in r}), None)
    if head is None:
        raise ValueError("no header row")
    at = {h: next(k for k, (c, _) in enumerate(parser.rows[head]) if key(c) == key(h)) for h in header}
    out: dict[str, dict] = {}
    for r in parser.rows[head + 1 :]:
        if len(r) > max(at.values()) and re.fullmatch(id_pattern, r[at[header[0]]][0]):
            link = next((h for _, h in r if h), None)
            out.setdefault(r[at[header[0]]][0], {"cells": {h: r[k][0] for h, k in at.items()}, "link": urljoin(base, link) if link else None})
    return list(out.values())


def html_table(pages: DataFrame, header: Sequence[str], id_pattern: str, strict: bool = False) -> DataFrame:
    """(path, cells, link, error) of the tables in pages(path, content); path is the base of relative links."""
    return _decoded(pages, lambda path, content: html_rows(bytes(content).decode("utf-8", "replace"), path, header, id_pattern), "cells map<string,string>, link string", strict)


def ocr_pages(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page, text): pages between form feeds, from 1; a blank last one is left out."""
    parts = F.split(F.col(text), "\f")
    trimmed = F.when(F.trim(F.element_at(parts, -1)) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return df.select(key, F.posexplode(trimmed).alias("page", "text")).withColumn("page", F.col("page") + 1)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of JSONL files, and their broken lines as (value, file, line), counted from 1; strict stops at one.

    Lines are numbered without a shuffle of rows: the place within its block of the file, beside the lines of the
    blocks before it.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    parsed = raw.select("*", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("x")).where("trim(value) <> ''")
    if strict:
        parsed = parsed.withColumn("x", F.when(F.col("x._bad").isNotNull(), F.raise_error(F.concat(F.lit("broken line: "), F.substring("value", 1, 80))).cast(parsed.schema["x"].dataType)).otherwise(F.col("x")))
    blocks = raw.groupBy("__file", "__block").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__file").orderBy("__block")) - F.col("__n")
    broken = parsed.where("x._bad IS NOT NULL").join(blocks.select("__file", "__block", "__first", before.alias("__before")), ["__file", "__block"])
    broken = broken.select("value", F.col("__file").alias("file"), (F.col("__at") - F.col("__first") + F.col("__before") + 1).alias("line"))
    return parsed.where("x._bad IS NULL").select("x.*").drop("_bad"), broken


def nested_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents as nested JSON, one per file, gzip or not; files that don't parse have a row with only _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def raster_cube(lines: DataFrame, bands: int) -> DataFrame:
    """(line, column, spectrum) of band images given as lines(band, line, text) of tab-separated numbers.

    A line that a band lacks, or with another number of columns, stops the job.
    """
    cells = lines.select("line", "band", F.posexplode(F.split("text", "\t")).alias("column", "v")).withColumn("v", F.col("v").try_cast("double"))
    cube = cells.groupBy("line", "column").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("band", "v"))), lambda x: x["v"]).alias("spectrum"))
    whole = F.when(F.col("n") != bands, F.raise_error(F.concat(F.lit("bands differ in shape at line "), F.col("line").cast("string"))).cast("array<double>")).otherwise(F.col("spectrum"))
    return cube.select("line", "column", whole.alias("spectrum"))
