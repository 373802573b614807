from pyspark.sql import functions as F

from folioscope.functions import identifiers, names, rules, text
from folioscope.operators import dedup, facets, grouping, keywords, linkage, rank
from tests.test_functions import one


def test_predicates(spark):
    s = lambda f, *v: one(spark, f(*[F.lit(x) for x in v]))
    assert s(rules.source_file, "image", 70_000) and not s(rules.source_file, "image", 10) and s(rules.source_file, "document", 1) and not s(rules.source_file, "other", 9)
    assert s(rules.ignored_file, ".x") and s(rules.ignored_file, "~$a.docx") and s(rules.ignored_file, "a.part") and not s(rules.ignored_file, "a.pdf")
    assert s(rules.internal_title, "Table of contents") and not s(rules.internal_title, "A mass")
    assert s(rules.generic_name, "scan 0001") and not s(rules.generic_name, "mass for voices")
    assert s(rules.person_like, "Ludwig van Beethoven") and not s(rules.person_like, "the red book") and not s(rules.person_like, "Coimbra University")
    assert s(rules.bad_file_name, "a/CON.txt") and s(rules.bad_file_name, "a?b") and not s(rules.bad_file_name, "a/b.txt")
    assert s(rules.modern_edition, "manuscript", 1900, 1750) and not s(rules.modern_edition, "manuscript", 1760, 1750) and s(rules.modern_edition, "printed", 1600, 1600)
    assert s(rules.form_contradiction, "printed", "autograph") and not s(rules.form_contradiction, "printed", "paper")
    assert s(rules.siglum_abbreviates, "P-Cug", "P-Cuimg") and not s(rules.siglum_abbreviates, "P-Cug", "D-Cug") and not s(rules.siglum_abbreviates, "P-Cgu", "P-Cug")
    assert [s(rules.retry_wait, n) for n in range(5)] == [0, 10, 60, 360, 360]
    assert s(text.useful_text, "x" * 250, 2) and not s(text.useful_text, "1" * 900, 2)


def test_values(spark):
    assert one(spark, rules.aligned_distance(F.array(F.lit(1.0), F.lit(2.0), F.lit(9.0)), F.array(F.lit(1.0), F.lit(5.0), F.lit(2.0), F.lit(8.0)), 2)) == 1.0
    assert one(spark, rules.allowed_metadata(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(" "), F.lit("c"), F.lit("2")), F.array(F.lit("a"), F.lit("b")))) == {"a": "1"}
    assert one(spark, rules.name_information(F.lit("Doe - Sonata BWV 5 in G.pdf"))) == 4 + 1 / 3
    a = F.array(F.struct(F.lit(None).cast("string").alias("literal"), F.lit("Ed").alias("surname"), F.lit("X").alias("given"), F.lit("translator").alias("role")), F.struct(F.lit(None).cast("string").alias("literal"), F.lit("Doe").alias("surname"), F.lit("J").alias("given"), F.lit(None).cast("string").alias("role")))
    assert one(spark, names.principal(a)) == "Doe" and one(spark, names.display(a, 1)) == "Ed, X et al."
    assert one(spark, grouping.base_name(F.lit("Mass p_012"))) == "Mass p"
    assert one(spark, keywords.cascade(("author", F.array().cast("array<string>")), ("catalogue", F.array(F.lit("x"))))).origin == "catalogue"
    assert one(spark, identifiers.urls(F.lit("a http://x.org/1, http://x.org/1, b"))) == ["http://x.org/1,"]
    assert one(spark, rank.replace_ok(F.lit(False), F.lit(True), F.lit(True), F.lit(None).cast("boolean"), F.lit(0.85)))
    assert one(spark, facets.extension(F.lit("http://a.b/c/d.PDF?x=1"))) == "pdf"
    assert one(spark, text.drop_empty(F.create_map(F.lit("a"), F.lit(""), F.lit("b"), F.lit("1")))) == {"b": "1"}


def test_joins(spark):
    prints = spark.createDataFrame([(1, "g", "00000000"), (2, "g", "00000011"), (3, "h", "00000000"), (4, "g", "11111111")], "id long, g string, bits string")
    assert [tuple(r) for r in dedup.fingerprint_pairs(prints, 8, 2, "g").collect()] == [(1, 2, 2)]
    pts = spark.createDataFrame([(1, 0.0), (2, 9.99), (3, 25.0)], "id int, x double")
    rng = spark.createDataFrame([("a", 0.0, 10.0), ("b", 9.0, 30.0)], "r string, lo double, hi double")
    assert {(r.id, r.r) for r in linkage.range_join(pts, rng, "x", "lo", "hi", 4.0).collect()} == {(1, "a"), (2, "a"), (2, "b"), (3, "b")}
    total = grouping.running_total(spark.createDataFrame([(i, i) for i in range(50)], "k int, v int"), F.col("k").asc(), F.col("v"))
    assert all(r.before == sum(range(r.k)) for r in total.collect())
