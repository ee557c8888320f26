import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selenite.sources import readers, sinks
from selenite.streaming.incremental import follow, process_new

XML = """<?xml version="1.0"?><p:Product xmlns:p="urn:x"><p:logical_identifier>urn:lab:spectra:c1</p:logical_identifier><p:version_id>1.0</p:version_id><p:title>T</p:title>
<p:specimen_name>76535</p:specimen_name><p:File><p:file_name>c1.tab</p:file_name></p:File><p:Table_Character><p:offset unit="byte">3</p:offset><p:records>2</p:records><p:Record_Character><p:record_length>12</p:record_length>
<p:Field_Character><p:name>Wavelength</p:name><p:field_number>1</p:field_number><p:field_location>1</p:field_location><p:field_length>5</p:field_length><p:unit>nm</p:unit></p:Field_Character>
<p:Field_Character><p:name>Reflectance</p:name><p:field_number>2</p:field_number><p:field_location>6</p:field_location><p:field_length>5</p:field_length></p:Field_Character></p:Record_Character></p:Table_Character></p:Product>"""


def test_csv_and_sniffing(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿id,Name\n1,"x ""q"" y"\n2,\n'.encode())
    df = readers.csv_table(spark, str(tmp_path / "a.csv"), ["id"])
    assert [tuple(r) for r in df.collect()] == [("1", 'x "q" y'), ("2", None)]
    with pytest.raises(ValueError, match="lacks columns: other"):
        readers.csv_table(spark, str(tmp_path / "a.csv"), ["other"])
    (tmp_path / "b.txt").write_text("Specimen Name;Sample-ID\n 76535 ;m1\n10084;\n")
    got = readers.sniffed_table(spark, str(tmp_path / "b.txt"), {"name": ["specimen_name"], "id": ["sampleid"]}, ["name"], "id").collect()
    assert sorted((r.source_row, r.name, r.id) for r in got) == [(2, "76535", "m1"), (3, "10084", "csv-row-000003")]
    (tmp_path / "many").mkdir()
    for k in range(3):
        (tmp_path / "many" / f"{k}.txt").write_text(f"name;id\n{k}a;\n{k}b;\n")
    got = readers.sniffed_table(spark, str(tmp_path / "many"), {"name": [], "id": []}, ["name"], "id").collect()
    assert sorted((r.name, r.source_row) for r in got) == [(f"{k}{x}", n) for k in range(3) for x, n in (("a", 2), ("b", 3))]
    schema = T._parse_datatype_string("a string")
    assert readers.optional_table(spark, str(tmp_path / "none.csv"), schema)[1] is False


def test_labels_and_fixed_width(spark, tmp_path):
    (tmp_path / "c1.xml").write_text(XML)
    (tmp_path / "bad.xml").write_text("<a>")
    labels = readers.labels(readers.files(spark, str(tmp_path), "*.xml"))
    good = labels.where("error IS NULL").collect()
    assert [(r.identifier, r.specimen_name, r.file_name, r.records, r.record_length) for r in good] == [("urn:lab:spectra:c1", "76535", "c1.tab", 2, 12)] and labels.where("error IS NOT NULL").count() == 1
    tables = spark.createDataFrame([("c1.tab", bytearray(b"2\r\n  280 0.10\r\n  285 0.20\r\nfooter"))], "file_name string, content binary")
    got = readers.fixed_width_points(tables, labels.where("error IS NULL")).orderBy("point").collect()
    assert [(r.point, r["values"]) for r in got] == [(0, [280.0, 0.1]), (1, [285.0, 0.2])]
    short = spark.createDataFrame([("c1.tab", bytearray(b"2\r\n"))], "file_name string, content binary")
    assert "label needs" in readers.fixed_width_points(short, labels.where("error IS NULL")).first().error
    roles = spark.createDataFrame([("Wavelength (nm)",), ("Standard Deviation",), ("Reflectance",), ("x",)], "n string").select(readers.field_role(F.col("n")).alias("r"))
    assert [r.r for r in roles.collect()] == ["wavelength", "uncertainty", "reflectance", None]


def test_other_formats(spark, tmp_path):
    lines = [("f", k, t) for k, t in enumerate(["junk", "Wavelength Reflectance", "0.5, 0.1", "bad", "0.6;0.2"])]
    curve = readers.ascii_curve(spark.createDataFrame(lines, "f string, k int, t string"), "f", "k", "t")
    assert [(r.x, r.y) for r in curve.orderBy("k").collect()] == [(500.0, 0.1), (600.0, 0.2)]
    matrix = spark.createDataFrame([("w", bytearray(struct.pack("<4f", 1, 2, 3, 4)))], "path string, content binary")
    assert [(r.axis, r.band, r.weight) for r in readers.float_matrix(matrix, 2, 350.0, 1.0).orderBy("axis", "band").collect()] == [(350.0, 1, 1.0), (350.0, 2, 2.0), (351.0, 1, 3.0), (351.0, 2, 4.0)]
    page = b"<table><tr><td>x<tr><th>Sample</th><th>Type</th></tr><tr><td><a href='../p/1.html'>10003</a></td><td>basalt <table><tr><td>no</td></tr></table></td></tr><tr><td>10003</td><td>again</td></tr><tr><td>total</td><td>2</td></tr></table>"
    got = readers.html_table(spark.createDataFrame([("http://h/a/b.html", bytearray(page))], "path string, content binary"), ["Sample", "Type"], "[0-9]{5}").collect()
    assert [(r.cells["Sample"], r.link) for r in got] == [("10003", "http://h/p/1.html")]
    pages = readers.ocr_pages(spark.createDataFrame([("d", "one\ftwo\f ")], "d string, t string"), "d", "t").collect()
    assert [(r.page, r.text) for r in pages] == [(1, "one"), (2, "two")]
    table = readers.delimited_by_label(spark.createDataFrame([("t.csv", bytearray(b"A b,C\n1,2\n3,\n"))], "path string, content binary"), ["A b", "C"], 2).orderBy("row").collect()
    assert [r.cells for r in table] == [{"A_b": "1", "C": "2"}, {"A_b": "3"}]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{bad\n\n{"a": 2}\n')
    fine, bad = readers.json_lines(spark, str(tmp_path / "x.jsonl"), "a int")
    assert sorted(r.a for r in fine.collect()) == [1, 2] and [(r.value, r.line) for r in bad.collect()] == [("{bad", 2)]
    (tmp_path / "doc.json.gz").write_bytes(gzip.compress(json.dumps({"pages": [{"n": 1}]}).encode()))
    assert readers.nested_json(spark, str(tmp_path / "doc.json.gz"), "pages array<struct<n:int>>").first().pages[0].n == 1
    cube = readers.raster_cube(spark.createDataFrame([(b, 0, f"{b}\t{b + 10}") for b in (1, 2)], "band int, line int, text string"), 2)
    assert {(r.column, tuple(r.spectrum)) for r in cube.collect()} == {(0, (1.0, 2.0)), (1, (11.0, 12.0))}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, None), ("b", None, "x")], "k string, v double, t string")
    out = str(tmp_path / "out")
    sinks.write_csv(df, out, ["v", "k"], sentinels={"v": -99.0})
    assert sorted(tuple(r) for r in readers.csv_table(spark, out).collect()) == [("-99.0", "b"), ("1.5", "a")]
    with pytest.raises(ValueError, match="other columns"):
        sinks.write_csv(df, out, ["k"], mode="append")
    with pytest.raises(FileExistsError):
        sinks.refuse_existing(spark, [out], overwrite=False)
    row = sinks.manifest(spark, {"t": df}, {"p": "1"}, spark.createDataFrame([("w2",), ("w1",)], "warning string")).first()
    assert row.counts == {"t": 2} and row.parameters == {"p": "1"} and row.warnings == ["w1", "w2"]
    tasks = sinks.task_lines(spark.createDataFrame([("u", 2), ("u", 1)], "u string, i int"), "u", "i")
    assert tasks.first().value == "u\t1,2"


def test_incremental(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    rows = lambda *x: spark.createDataFrame(list(x), "k int, t string")
    batches = [rows((1, "a"), (2, "b")), rows((1, "a"), (2, "c"), (3, "d"))]
    want = [(1, "a", 0), (2, "b", 0), (2, "c", 1), (3, "d", 1)]
    shown = lambda: sorted((r.k, r.t, r.run) for r in spark.read.parquet(out).collect())
    for n in (0, 1, 1, 0):  # runs that come again change nothing
        process_new(batches[n], log, lambda d: d.select("k", "t"), out, "k", "t", n)
        assert [x for x in shown() if x in want] == shown()
    assert shown() == want

    def fails(d):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        process_new(rows((9, "x")), log, fails, out, "k", "t", 2)
    process_new(rows((9, "x")), log, lambda d: d.select("k", "t"), out, "k", "t", 2)
    assert shown() == [*want, (9, "x", 2)]
    new = process_new(rows((2, "b"), (3, "d")), log, lambda d: d.select("k", "t"), out + "-new", "k", "t")
    assert [tuple(r) for r in spark.read.parquet(f"{out}-new/run={new}").collect()] == [(2, "b")]  # a stale digest is pending again
    rows((7, "z")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, t string").parquet(str(tmp_path / "in"))
    follow(stream, str(tmp_path / "log2"), lambda d: d.select("k"), str(tmp_path / "out2"), "k", "t", str(tmp_path / "ck")).awaitTermination()
    assert [r.k for r in spark.read.parquet(str(tmp_path / "out2")).collect()] == [7]


def test_manifest_digests_and_layers(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 1.5, 3), (300, 1, 2.5, 4)], "line int, sample int, feo double, flags int")
    sinks.write_layers(df, str(tmp_path / "r"), "line", {"feo": "float", "flags": "short"})
    back = spark.read.parquet(str(tmp_path / "r"))
    assert dict(back.dtypes) == {"line": "int", "sample": "int", "feo": "float", "flags": "smallint", "block": "int"}
    assert sorted((r.line, r.block, r.feo) for r in back.collect()) == [(0, 0, 1.5), (300, 1, 2.5)]
    files = readers.files(spark, str(tmp_path / "r"), "*.parquet").select("path", "sha256")
    row = sinks.manifest(spark, {"r": df}, {}, files=files).first()
    assert len(row.sha256) == 2 and all(len(x) == 64 for x in row.sha256.values())
