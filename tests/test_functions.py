import pytest
from pyspark.sql import functions as F

from folioscope.functions import dates, identifiers, names, similarity, text
from folioscope.operators import edit, facets, keywords, rank, search
from folioscope.operators.components import connected_components
from folioscope.operators.grouping import batch_key


def one(spark, c, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(c.alias("x")).first().x


def test_text(spark):
    t = lambda f, s: one(spark, f(F.col("s")), s=s)
    assert t(text.normalise, "  Évora: Côr d'Água—ñ 12 ") == "evora cor d agua n 12"
    assert t(text.reader_normalise, "Œuvre Straße æſ") == "oeuvre strasse aes"
    assert t(text.latin, "Jvlius") == "iulius"
    assert t(text.title_key, '"The Art of 12 Fugues') == "art of 00000012 fugues"
    assert t(text.title_key, "L'Orfeo") == "orfeo" and t(text.title_key, " !") is None
    assert t(text.words, "a To be or to BE") == ["to", "be", "or"]
    assert t(text.safe_segment, "a/b:  c") == "a-b- c"
    assert t(text.safe_path, "a/b.pdf") and not t(text.safe_path, "a/../b") and not t(text.safe_path, "/a")
    assert one(spark, text.filled(F.lit("{a}-{b}"), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")))) == "1-2"


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("Missa brevis", "missa BREVIS!", True), ("A long enough title for the prefix rule", "A long enough title for the prefix rule and more", True), ("A long enough title for the prefix rule 1", "A long enough title for the prefix rule 2", False), ("Short", "Short one", False)],
)
def test_title_equal(spark, a, b, same):
    assert one(spark, similarity.title_equal(F.col("a"), F.col("b")), a=a, b=b) is same


def test_similarity(spark):
    two = lambda f, a, b: one(spark, f(F.col("a"), F.col("b")), a=a, b=b)
    assert two(similarity.dice, "the red book", "red book") == 0.8 and two(similarity.dice, "", "x y") == 0.0
    assert two(similarity.containment, "one two three", "three two one zero") == 1.0 and two(similarity.containment, "one two", "one two") == 0.0
    assert two(similarity.years_ok, "c. 1750", "1750-03") and two(similarity.years_ok, None, "1750") and not two(similarity.years_ok, "1750", "1751")
    assert two(similarity.surname_like, "monteverde", "monteverdi") and not two(similarity.surname_like, "bach", "beck")
    assert one(spark, similarity.hamming(F.array(F.lit(5), F.lit(0)), F.array(F.lit(6), F.lit(1)))) == 3


def test_identifiers(spark):
    f = lambda g, s: one(spark, g(F.col("s")), s=s)
    assert f(identifiers.isbn_valid, "0306406152") and f(identifiers.isbn_valid, "9780306406157") and not f(identifiers.isbn_valid, "0306406153")
    assert f(identifiers.isbn13, "0306406152") == "9780306406157" and f(identifiers.isbn10, "9780306406157") == "0306406152"
    assert f(identifiers.ean_valid, "036000291452") and f(identifiers.ean_valid, "4006381333931") and not f(identifiers.ean_valid, "4006381333930")
    assert f(identifiers.ean_candidates, "006381333931") == ["4006381333931"]
    assert f(identifiers.dois, "see doi:10.1000/ABC.1, and (10.1000/xyz).") == ["10.1000/abc.1", "10.1000/xyz"]


def test_dates_and_names(spark):
    f = lambda g, s: one(spark, g(F.col("s")), s=s)
    assert f(dates.year, "c. 1685/86") == 1685 and f(dates.year, "none") == 0
    assert f(dates.date_key, "1750-07") == 17500700 and f(dates.date_key, "unknown") is None
    assert tuple(f(dates.csl_date, "1750-07-28")) == (1750, 7, 28, False, None) and tuple(f(dates.csl_date, "c. 1520")) == (1520, None, None, True, None) and f(dates.csl_date, "s. d.").literal == "s. d."
    assert f(dates.roman, "MDCCXLIX") == 1749 and f(dates.duration, 3725) == "1:02:05" and f(dates.century, 1700) == 17
    person = lambda s: tuple(f(names.person, s))
    assert person("Bach, Johann  Sebastian") == ("Bach", "Johann Sebastian", None)
    assert person("Ludwig van Beethoven") == ("van Beethoven", "Ludwig", None) and person("Palestrina") == ("Palestrina", None, None)
    assert person("van der Velde") == ("der Velde", "van", None) and person("Coimbra University Library") == (None, None, "Coimbra University Library")
    assert f(names.split_artists, "A & B feat. C, D") == ["A", "B", "C", "D"]


def test_query_compiler():
    assert search.compile_query('"of the" d\'Água x') == [search.Term(("of", "the"), False), search.Term(("d", "agua"), True), search.Term(("x",), True)]
    assert search.number_of("#12") == 12 and search.number_of("12a") is None


def test_choice_and_edit(spark):
    c = spark.createDataFrame([(1, 1, 1.0, "a"), (1, 2, 0.97, "b"), (2, 3, 0.9, "a"), (2, 4, 0.87, "b"), (3, 5, 0.9, "a"), (3, 6, 0.89, "a"), (4, 7, 0.5, "a"), (5, 8, 1.0, "a"), (5, 9, 1.0, "b")], "q int, id int, confidence double, work string")
    got = {r.q: (r.winner, r.decision) for r in rank.choose(c, "q", "work").collect()}
    assert got == {1: (1, "accepted"), 2: (3, "tie"), 3: (5, "accepted"), 4: (7, "low"), 5: (8, "tie")}
    with pytest.raises(ValueError):
        edit.validated({"x": ("replace", "y")}, ["z"])
    with pytest.raises(ValueError):
        edit.validated({"z": ("replace", "")}, ["z"])
    assert one(spark, edit.protect(F.lit("2019-07-17"), F.lit("2019"), F.lit(False), True)) == "2019-07-17"
    df = spark.createDataFrame([(0,), (1900,), (2000,)], "y int")
    assert df.where(facets.facet_filter(years=("y", None, 1950))).count() == 2 and df.where(facets.facet_filter(years=("y", None, 1950), unknown_year="dropped")).count() == 1
    assert one(spark, batch_key(F.lit("Mass in B 12 kyrie"))) == "mass in b" and one(spark, batch_key(F.lit("12 ab"))) is None
    assert one(spark, keywords.author_keywords(F.lit("x\nKeywords: music; early music, lute.\n"))) == ["music", "early music", "lute"]


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (None, 3), (7, 8), (8, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1000 for i in range(1000, 1100)}, 7: 7, 8: 7}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
