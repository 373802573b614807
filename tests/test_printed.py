import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.functions import layout
from folioscope.operators import printed
from folioscope.plans import prints
from folioscope.plans.catalogue import ORACLE_SQL
from tests.compare import compared

STAFF = "  &b c  œ œ œ œ   ˙ ˙   œ œ œ œ   w w   œ œ œ œ    ˙ ˙   œ œ œ œ   w w   œ œ œ œ  "
PAGES = {
    "chanson": (f"  Cancionero Tal IV.b.2\n  fol. 12 v - 13             7. Je ne puis chanter ainsi                       Pierrot (fl ca 1450)\n                                   ABAAABAB\n{STAFF}\n   Ver - bum ca - ro\n\n  © Copyright Jane Doe\n", {"title": "7. Je ne puis chanter ainsi", "composers": ["Pierrot (fl ca 1450)"], "sources": ["Cancionero Tal IV.b.2", "fol. 12 v - 13"], "holder": "Jane Doe", "part": None}),
    "part": (f"bassus\nCourt Dances...Nos. 139-142\n(Playfair, London, 1655)\n                            [Suite in C]                     Mr. Richard Roe\n{STAFF}\n©2006 John Doe\n", {"part": "bassus", "title": "Suite in C", "composers": ["Mr. Richard Roe"], "sources": ["Court Dances...Nos. 139-142", "(Playfair, London, 1655)"], "holder": "John Doe", "year": "2006"}),
    "score": (f"                            [Suite in C]                     Mr. Richard Roe\n treble\n{STAFF}\n bassus\n{STAFF}\n", {"part": None, "parts": ["treble", "bassus"], "title": "Suite in C"}),
    "corner": (f"Violin                      La Folia Nova\n                                                       J. C. Schick\n\n{STAFF}\n       © 2007 L'Universo Nuovo\n", {"part": "Violin", "title": "La Folia Nova", "composers": ["J. C. Schick"], "holder": "L'Universo Nuovo", "year": "2007"}),
    "under": (f"                            Te Lucis Ante (1996)\n                         Hymnus ad completorium\n  arr. Lucy Martin                                  by Anonymous\n{STAFF}\nPDF © 2001-2008 Ann Lee .\n", {"title": "Te Lucis Ante", "composed": "1996", "subtitle": "Hymnus ad completorium", "editors": ["Lucy Martin"], "composers": ["Anonymous"], "year": "2008", "holder": "Ann Lee"}),
    "catalogue": (f"                          Es erhub sich\n\nBWV 19.7                                             Bachmeister\n{STAFF}\n", {"title": "Es erhub sich", "catalogue": "BWV 19", "composers": ["Bachmeister"]}),
    "empty": ("", {"title": None, "composers": [], "parts": [], "part": None, "holder": None}),
    "null": (None, {"title": None, "others": []}),
    "music only": (f"{STAFF}\n{STAFF}\f{STAFF}", {"title": None, "subtitle": None}),
}


@pytest.fixture(scope="module")
def read(spark):
    pages = spark.createDataFrame([(k, p) for k, (p, _) in PAGES.items()], "name string, page string")
    known = spark.createDataFrame([("Bachmeister",)], "surname string")
    return {r["name"]: r.asDict() for r in printed.first_pages(pages, "name", "page", known).collect()}


@pytest.mark.parametrize("name", PAGES)
def test_first_page(read, name):
    assert {k: read[name][k] for k in PAGES[name][1]} == PAGES[name][1]


def test_every_page_has_one_row(read):
    assert set(read) == set(PAGES)


def test_rights_parts_and_persons(spark):
    cases = {"© 2007 L'Universo Sommerso": "L'Universo Sommerso", "                 PDF © 2004 Margaret Greentree": "Margaret Greentree", "Copyright © 2005 by Anders Sten (under CPDL lisence)": "Anders Sten", "Typeset by JD . Copyright © 2007. Reference: Mutopia-2007/05": "Mutopia Project"}
    df = spark.createDataFrame(list(cases.items()), "t string, holder string")
    assert df.where(F.coalesce(layout.rights(F.col("t"))["holder"], F.lit("")) != F.col("holder")).count() == 0
    labels = {"Tenor": True, "bassus": True, "Alto Recorder 2": True, "[Superius I]": True, "II Dessus": True, "Haute Contre": True, "Violino 1": True, "Flauto dolce tenore": True, "La Folia": False, "Samuel Scheidt": False, "Suite in C": False, "Prima pars de": False}
    got = {r.t: r.x for r in spark.createDataFrame([(k,) for k in labels], "t string").select("t", layout.part_label(F.col("t")).alias("x")).collect()}
    assert got == labels
    people = {"Francesco Barsanti (1690-1772)": True, "Joh.Seb. Bach": True, "Stephanus de la Rue": True, "Suite in C": False, "All of me": False, "To Mary Jones": False, "Largo": False, "x": False, "Anonymous": True, "Henry Purcell 1659-1695": True}
    got = {r.t: r.x for r in spark.createDataFrame([(k,) for k in people], "t string").select("t", layout.person(F.col("t")).alias("x")).collect()}
    assert got == people


def test_cells_know_their_places(spark):
    df = spark.createDataFrame([(1, "   œ œ œ &c xyz\n abc d  efg\thij\n\n     word œ\nlonger")], "k int, p string")
    got = [(r.line, r.at, r.text, round(r.left * 60), round(r.right * 60)) for r in printed.cells(df, "k", "p").orderBy("line", "at").collect()]
    # the margin is three blanks, the width 60 less these
    assert [(a, b, c) for a, b, c, *_ in got] == [(1, 0, "abc d"), (1, 1, "efg"), (1, 2, "hij"), (3, 0, "word"), (4, 0, "longer")]
    assert [(round(r[3] * 57 / 60), round(r[4] * 57 / 60)) for r in got] == [(0, 3), (5, 8), (9, 12), (2, 8), (0, 3)]


def test_words_end_before_accented_letters_as_in_sql(spark, tmp_path):
    """Each text's second line is cut after 26 characters, so its first cell begins with a mark and an accented letter."""
    heads = ["Ralló se. Do ciónos quetac", "Tuttiél canto de las voces", "ANÓNIMO canta de las voces", "Ed.é canta de las voces xx", "Copyrightó de las voces xx", "Sub de las voces y cantares"]
    texts = [f"Del mundo canta el gran señor de todas\n{h}i íes ómente y mas palabras\n{h} otras palabras aqui" for h in heads]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [[i, x] for i, x in enumerate(texts)])
    con.sql("FROM t").write_parquet(f"{tmp_path}/documents.parquet")
    compared(spark, tmp_path, "first_page_parser", prints.first_page_parser, ORACLE_SQL["first_page_parser"])


def test_pages_stay_in_their_rows(spark, sf):
    plan = prints.first_page_parser(spark, sf)._jdf.queryExecution()
    assert "Exchange" not in plan.executedPlan().toString() and plan.executedPlan().toString().count("FileScan") == 1
    # the text's length is not counted again for every line
    assert all(line.count("length(text") <= line.split("transform(")[0].count("length(text") for line in plan.optimizedPlan().toString().split("\n"))


def test_quick_looks_find_what_the_patterns_find(spark):
    words = ["fol. 12", "Codexó", "xcodex", "CODEX", "pp.3", "(Playfair, London, 1655)", "libro de", "a www.x", "wwwx", "httpſ:", "x.net", "x.nets", "©", "Copyrightó", "Ver - bum", "ca-ro ho-mo", "abcd", "abcde", "a - b"]
    texts = [f"{a}{b}{c}" for a in ("", "De ", "é") for b in words for c in ("", " xy", "é")]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    for quick, pattern in ((layout.source, layout.SOURCE), (layout.web, layout.WEB), (layout.sung, layout.SUNG)):
        got = df.select("t", quick(F.col("t")).alias("quick"), F.col("t").rlike(layout.alike(pattern)).alias("plain")).collect()
        assert [r for r in got if r.quick != r.plain] == [] and len({r.quick for r in got}) == 2
    lines = {"&b c œ": True, "x &b c œ": True, "x&b c œ": False, "\t? 3 w": True, "V bb# 12 ˙": True, "Vb 123 ˙": False, "B c xœ": True, "B c x": False}
    got = {r.t: r.x for r in spark.createDataFrame([(k,) for k in lines], "t string").select("t", layout.staff_line(F.col("t")).alias("x")).collect()}
    assert got == lines
    words = {"Tenor": False, "tenor bajo": False, "wWb": False, "tenores": True, "bc alto Jo": False, "alto Jor": True, "ÓÔb": False, "Óscar": True, "ſuite": True}
    got = {r.t: r.x for r in spark.createDataFrame([(k,) for k in words], "t string").select("t", layout.meaning(F.col("t")).alias("x")).collect()}
    assert got == words
    people = {"Henry de Purcell": True, "Henry of Purcell": False, "Anon. of the city": True, "Mr. Anonymous of it": True, "Henry Purcell (of the 17 cities)": True, "della Rovere": True, "Henry Purcell of": False}
    got = {r.t: r.x for r in spark.createDataFrame([(k,) for k in people], "t string").select("t", layout.person(F.col("t")).alias("x")).collect()}
    assert got == people


def test_known_surnames_name_composers_of_their_own_pages(spark):
    pages = spark.createDataFrame([(1, f"                          Es erhub sich\n\nBachmeister\n{STAFF}\n"), (2, f"                          Es erhub sich\n\nMeisterbach\n{STAFF}\n")], "k int, p string")
    known = spark.createDataFrame([("Bachmeister",), ("bachmeister",), ("Erhub",)], "surname string")
    assert {r.k: r.composers for r in printed.first_pages(pages, "k", "p", known).collect()} == {1: ["Bachmeister"], 2: []}


def test_wide_blanks_dots_and_anonymous_sources_as_in_sql(spark, tmp_path):
    cells = ["Del mundo ", " Gran Codex ", "anon ", "(Tenor) ", "BASSUS C.", "C. 1 alto.", "Anonymous Codex", "incertus nos. 3", "Anon. canta", "codex s.XVI", "Henry Purcell (1659-1695)", "la\u000bvoz"]
    texts = [f"{a}\nuna\n{b}\n  {a}  {b}\t{a}\n{b}" for a in cells for b in cells]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [[i, x] for i, x in enumerate(texts)])
    con.sql("FROM t").write_parquet(f"{tmp_path}/documents.parquet")
    compared(spark, tmp_path, "first_page_parser", prints.first_page_parser, ORACLE_SQL["first_page_parser"])
