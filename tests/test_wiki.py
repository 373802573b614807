import random

from pyspark.sql import functions as F

from folioscope.functions import wiki

PAGE = """{{#fte:imslppage
| *****AUDIO*****
|Work Title='''6 Sonatas'''
|Alternative Title=[[Sonate|Sonate a due]]
|Page Type=Collection page
|Instrumentation=flute, {{Cite|x|y}} continuo
|Year of First Publication=1707 {{RISMc|990012345}} or {{LinkName|A|{{B|c}}}}
|*****FILES*****
}}
===Scores===
{{#fte:imslpfile
|File Name 1=PMLP0123-Roe_Sonatas.pdf
|File Name 2=PMLP0124-Roe_Parts.pdf
|Editor={{FE}}
|Publisher Information={{P|Roger.|Estienne Roger|Amsterdam,|n.d.|ca.1707||Plate 9}}
|Misc. Notes=see {{LinkEd|a|b}}
}}
{{#fte:imslpfile
|File Name 1=PMLP0125-Roe.pdf
|Editor=[[Doe, Jane|Jane Doe]]
|Publisher Information=unknown {{Unclear|a|b}}
}}
{{#fte:imslpfile |File Name 1=lost.pdf"""


def test_a_page_with_nested_templates(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "no page }} here {{")], "id int, page string")
    got = {r.id: r.p for r in df.select("id", wiki.work_page(F.col("page")).alias("p")).collect()}
    p = got[1]
    assert (p.title, p.alternative, p.collection, p.instrumentation, p.first_year, p.first_source) == ("6 Sonatas", "Sonate a due", True, "flute, continuo", 1707, "990012345")
    assert [tuple(e) for e in p.editions] == [(["PMLP0123-Roe_Sonatas.pdf", "PMLP0124-Roe_Parts.pdf"], None, "Roger", "Estienne Roger", "Amsterdam", 1707), (["PMLP0125-Roe.pdf"], "Jane Doe", None, None, None, None)]
    assert (got[2].title, got[2].editions, got[3].editions) == (None, [], [])


def test_balance_and_fields(spark):
    df = spark.createDataFrame([("a{{b|{{c|d}}|[[e|f]]|g=h=i}}j{{k}}",)], "t string")
    r = df.select(wiki.templates(F.col("t")).alias("t"), F.transform(wiki.templates(F.col("t")), wiki.fields).alias("f"), F.transform(F.transform(wiki.templates(F.col("t")), wiki.fields), wiki.named).alias("n")).first()
    assert r.t == ["c|d", "b|{{c|d}}|[[e|f]]|g=h=i", "k"]
    assert r.f == [["c", "d"], ["b", "{{c|d}}", "[[e|f]]", "g=h=i"], ["k"]] and r.n == [{}, {"g": "h=i"}, {}]


def test_printers_and_files(spark):
    df = spark.createDataFrame([(PAGE,)], "page string").select(wiki.work_page(F.col("page"))["editions"].alias("e"))
    r = df.select(*[wiki.printer_is_person(F.lit(n), F.col("e")).alias(n) for n in ("Roger, Estienne", "Roger, Pierre", "Roe, R.")], *[wiki.edition_of_file(F.col("e"), F.lit(f))["printer"].alias(f) for f in ("roe parts.PDF", "PMLP0123-Roe_Sonatas.pdf", "other.pdf")], wiki.edition_of_file(F.col("e"), F.lit("PMLP0125-Roe.pdf"))["editor"].alias("ed")).first()
    assert list(r) == [True, True, False, "Roger", "Roger", "Roger", "Jane Doe"]


def test_one_pass_reads_what_the_expressions_read(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["{{", "}}", "[[", "]]", "|", "{", "}", "[", "]", "a", " b=c ", "\n", "P", "#fte:imslpfile"]) for _ in range(rng.randrange(1, 40))) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in [*texts, PAGE, ""]], "t string")
    assert [(r.t, r.f) for r in df.select("t", F.transform(wiki.templates(F.col("t")), wiki.fields).alias("f")).collect() if r.f != wiki._bodies(r.t)] == []
