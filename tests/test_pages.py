import io
import zipfile

from pyspark.sql import functions as F

from folioscope.functions import pages
from folioscope.sources import records
from tests.test_functions import one


def test_pages(spark):
    s = lambda f, v: one(spark, f(F.col("s")), s=v)
    words = spark.createDataFrame([([("Mass", 50.0, 10.2, 20.0), ("The", 10.0, 10.0, 20.0), ("Jane", 10.0, 60.0, 8.0), ("Doe", 40.0, 60.1, 8.0), ("1999", 10.0, 200.0, 6.0)],)], "w array<struct<text:string,x:double,y:double,height:double>>")
    r = words.select(pages.cover(pages.lines_of(F.col("w"))).alias("c")).first().c
    assert tuple(r) == ("The Mass", "Jane Doe", 1999)
    sheet = s(pages.article_sheet, "A Study of Bells\nAuthor(s): Jane Doe and Richard Roe\nSource: Some Journal, Vol. 12, No. 3 (Autumn, 1999), pp. 10-25\nPublished by: X\nStable URL: http://x.org/1\n")
    assert (sheet.title, sheet.authors, sheet.journal, sheet.volume, sheet.issue, sheet.year, sheet.pages, sheet.review, sheet.stable_id) == ("A Study of Bells", ["Jane Doe", "Richard Roe"], "Some Journal", "12", "3", 1999, "10-25", False, "http://x.org/1")
    assert s(pages.imprint_page, "Editor: Jane Doe\nDesign\n    Some Studio\nEditor: other\n") == {"editor": "Jane Doe", "design": "Some Studio"}
    assert one(spark, pages.page_of(F.lit("[p. 1] a [p. 2] bc [p. 3]"), F.lit(18))) == 2
    n = s(pages.notation_name, "Sonata in C minor BWV 1017 no. 2 v3 - violin I.musx")
    assert (n.part, n.version, n.number, n.key, n.catalogue) == ("violin", 3, 2, "C minor", "BWV 1017")
    c = s(pages.source_clues, "P-Cug MM 48 ff. 10r-12v 1559.pdf")
    assert tuple(c) == ("P-Cug", "MM 48", "10r-12v", 1559)
    assert one(spark, pages.best_name(F.array(F.lit("scan"), F.lit("Doe - Sonata BWV 5"), F.lit("x")))) == "Doe - Sonata BWV 5"
    assert not one(spark, pages.work_compatible(F.lit("Sonata in C minor"), F.lit("Sonata in D minor"))) and one(spark, pages.work_compatible(F.lit("Sonata"), F.lit("Sonata in D minor")))


def test_payloads(spark):
    solr = '<doc><str name="id">1</str><arr name="k"><str>a</str><str>b &amp; c</str></arr></doc>'
    assert one(spark, records.solr_docs(F.col("x")), x=solr) == [{"id": ["1"], "k": ["a", "b & c"]}]
    t = one(spark, records.media_tags(F.col("x")), x='{"format":{"duration":"12.5","tags":{"TITLE":"T"}}}')
    assert (t.tags, t.duration) == ({"title": "T"}, 12.5)
    m = one(spark, records.score_metadata(F.col("x")), x="<a><title>[Title]</title><title>Real</title><composer>Doe</composer></a>")
    assert (m.title, m.composer, m.rights) == ("Real", "Doe", None)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("a/score.xml", "<x/>")
        z.writestr("b.txt", "no")
    df = spark.createDataFrame([("p", bytearray(buf.getvalue())), ("q", bytearray(b"not a zip"))], "path string, content binary")
    assert [(r.path, r.member, bytes(r.content)) for r in records.zip_members(df, r"\.xml$").collect()] == [("p", "a/score.xml", b"<x/>")]


def test_each_veto_of_a_work(spark):
    ok = lambda t, w, **more: one(spark, pages.work_compatible(F.lit(t), F.lit(w), **more))
    assert ok("Concerto RV 9", "Violin Concerto, RV 9") and not ok("Concerto RV 8", "Violin Concerto, RV 9") and ok("Concerto RV 8", "Concerto, Op. 3")
    assert not ok("Sonata No. 2", "Sonata No. 3") and not ok("Sonata II", "Sonata III") and not ok("Sonata II", "10 Sonatas")
    assert not ok("Six Sonatas", "Recorder Sonata") and ok("Six Sonatas", "6 Sonatas") and not ok("Four pieces", "3 pieces")
    assert not ok("Zadok the Priest", "Coronation Anthems, HWV 258-261") and ok("Coronation Anthems", "Coronation Anthems, HWV 258-261")
    assert not ok("Sonata in C minor", "Sonata in C major") and not ok("Concerto", "Sonata") and ok("Concerto", "Nothing named")
    assert ok("Gigue", "Suite", movements=F.lit("Allemande\nGigue")) and not ok("Gigue", "Suite", movements=F.lit("Allemande"))
    assert ok("Prelude", "Cello Suite", movements=F.lit("Prelude\nAllemande")) and not ok("Prelude", "Cello Suite")
    none = F.lit(None).cast("string")
    assert one(spark, pages.work_compatible(none, F.lit("Sonata"))) and one(spark, pages.work_compatible(F.lit("Sonata"), none))
