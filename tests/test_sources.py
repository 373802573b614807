import pytest
from pyspark.sql import functions as F

from folioscope.sources import exports, records
from folioscope.streaming import ingest

BIB = """@book{key1,
  title = {A {Nested} Title},
  author = "Doe, Jane and Roe, Richard",
  year = 1999, isbn = {0306406152}
}
@article{, title={Second}, author={Solo}, date={2001-05}}
"""
RIS = "TY  - JOUR\nTI  - Third\nAU  - Doe, Jane\nAU  - Roe, R.\nPY  - 2003/04/05\nDO  - 10.1/X\nKW  - one\nER  -\nTY  - BOOK\nT1  - Fourth\nER  - \n"


def test_references(spark, tmp_path):
    (tmp_path / "a.bib").write_text(BIB)
    (tmp_path / "b.ris").write_text(RIS)
    got = {r.title: r for r in records.read_references(spark, str(tmp_path)).collect()}
    assert set(got) == {"A Nested Title", "Second", "Third", "Fourth"}
    assert got["A Nested Title"].authors == ["Doe, Jane", "Roe, Richard"] and got["A Nested Title"].date == "1999" and got["A Nested Title"].type == "book"
    assert got["Third"].doi == "10.1/x" and got["Third"].date == "2003-04-05" and got["Third"].keywords == ["one"] and got["Second"].date == "2001-05"


def test_marc_xml_and_html(spark):
    xml = '<m:datafield tag="245" ind1="1" ind2="0"><m:subfield code="a">A &amp; B</m:subfield><m:subfield code="b">C</m:subfield></m:datafield><m:datafield tag="700" ind1=" " ind2=" "><m:subfield code="a">D</m:subfield></m:datafield>'
    html = "<table><tr><th>Date</th><td>1750 <b>c.</b></td></tr><tr><td>Place</td><td>Porto</td></tr></table>"
    df = spark.createDataFrame([(xml, html)], "x string, h string")
    r = df.select(records.marc_values(records.marc_fields(F.col("x")), "245", "ab").alias("t"), records.xml_texts(F.col("x"), "subfield").alias("s"), records.html_pairs(F.col("h")).alias("p")).first()
    assert r.t == ["A & B C"] and r.s == ["A & B", "C", "D"] and r.p == {"Date": "1750 c.", "Place": "Porto"}


def test_exports_and_folder(spark, tmp_path):
    rows = [(1, "book", "T", [("Doe", "Jane")], 1999, "P", "L", None, "0306406152", None, "doe1999t")]
    df = spark.createDataFrame(rows, "id int, type string, title string, authors array<struct<surname:string,given:string>>, year int, publisher string, place string, doi string, isbn string, url string, key string")
    assert '"family":"Doe"' in exports.csl_json(df).first().json
    assert exports.bibtex(df, "key").first().entry.startswith("@book{doe1999t,\n  title = {T},\n  author = {Doe, Jane}")
    assert "AU  - Doe, Jane\nPY  - 1999" in exports.ris(df).first().entry
    back = records.read_ris(exports.ris(df).select(F.lit("p").alias("path"), F.concat("entry", F.lit("\n")).alias("content"))).first()
    assert (back.title, back.authors, back.type) == ("T", ["Doe, Jane"], "book")
    notes = spark.createDataFrame([(1, "T", 2, "note", "", "second", ["a b"]), (1, "T", 1, "quotation", "p. 3", "first", [])], "r int, title string, ord int, kind string, location string, text string, tags array<string>")
    assert exports.notes_markdown(notes, "r", "title").first().markdown.startswith("## T\n\n> first (p. 3)")
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_text("1")
    (tmp_path / "x" / ".b").write_text("2")
    got = records.files_under(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].size == 1
    exports.text_blocks(spark.createDataFrame([(1, "t"), (101, "u"), (2, "")], "n int, content string"), "n", str(tmp_path / "blocks"))
    assert {r.block for r in spark.read.json(str(tmp_path / "blocks")).collect()} == {1, 2}


def test_incremental_index_and_duplicates(spark, tmp_path):
    src, idx = tmp_path / "in", tmp_path / "idx"
    for i, rows in enumerate(([(1, "red book"), (2, "blue")], [(2, "green"), (3, "new")])):
        spark.createDataFrame(rows, "id int, title string").coalesce(1).write.mode("append").parquet(str(src))
        q = ingest.maintain_index(ingest.watched(spark, str(src), "id int, title string", "parquet"), "id", ["title"], str(idx), str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
    got = {r.id: r.tokens for r in spark.read.parquet(str(idx / "v1")).collect()}
    assert got == {1: ["red", "book"], 2: ["green"], 3: ["new"]}
    rows = spark.createDataFrame([("a.JPG",), ("b.pdf",), ("c",)], "path string").select(ingest.category().alias("c"))
    assert [r.c for r in rows.collect()] == ["image", "document", "other"]


def test_static_copy(spark, tmp_path):
    made = lambda *rows: spark.createDataFrame(list(rows), "path string, sha256 string")
    required, present, previous = made(("a", "1"), ("b", "2"), ("c", "3"), ("n", None)), made(("a", "1"), ("b", "x"), ("z", "3"), ("y", "3"), ("w", "9")), made(("y", "3"), ("w", "9"), ("w", "8"))
    got = {r.path: (r.action, r.source) for r in exports.static_plan(required, present, previous).collect()}
    assert got == {"a": ("up to date", None), "b": ("copy", None), "c": ("renamed", "y"), "n": ("copy", None), "y": ("delete", None), "w": ("delete", None), "z": ("junk", None)}
    assert exports.static_plan(made(), made(), made()).count() == 0
    blocks, path = (lambda *rows: spark.createDataFrame(list(rows), "block int, id int")), f"file://{tmp_path}/copy"
    exports.static_apply(blocks((1, 10), (2, 20)), {"copy": 2}, path)
    exports.static_apply(blocks((2, 21)), {"copy": 1, "up to date": 1}, path)
    assert {(r.block, r.id) for r in spark.read.parquet(path).collect()} == {(1, 10), (2, 21)}
    with pytest.raises(ValueError, match="refused"):
        exports.static_apply(blocks((1, 1)), {"delete": 9, "up to date": 1}, path)
