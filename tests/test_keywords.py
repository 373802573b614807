import time

from pyspark.sql import functions as F

from folioscope.operators import keywords


def found(spark, title, body, **options):
    docs = spark.createDataFrame([(1, title, body)], "id long, title string, text string")
    return [(r.phrase, r.value) for r in keywords.computed(docs, F.col("title"), F.col("text"), "id", **options).orderBy("rank").collect()]


FILL = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(90))  # each used once


def test_words_and_phrases_by_points(spark):
    assert found(spark, None, "lute " * 2 + FILL) == []  # two uses are too few
    assert found(spark, None, "lute the " * 4 + FILL) == [("Lute", 4.0)]
    assert found(spark, "On the lute", "lute the " * 4 + FILL) == [("Lute", 8.0)]
    assert found(spark, None, "lute the " * 4) == []  # under 80 words


def test_a_word_gives_way_to_its_phrase(spark):
    # the phrase: 4 * 1.6 = 6.4 points; the word inside it: 10, of which 40 % are 4
    assert found(spark, None, "figured bass the " * 4 + "bass the " * 6 + FILL)[0] == ("Figured bass", 6.4)
    assert ("Bass", 20.0) in found(spark, None, "figured bass the " * 4 + "bass the " * 16 + FILL)


def test_particles_stand_inside_phrases(spark):
    assert found(spark, None, "missa de requiem the " * 4 + FILL) == [("Missa de requiem", 7.6)]


def test_names_count_if_the_title_has_them(spark):
    body = "by Mozart and with lute the " * 4 + FILL
    assert found(spark, None, body) == [("Lute", 4.0)]
    assert found(spark, "Mozart", body) == [("Mozart", 8.0), ("Lute", 4.0)]


def test_references_and_the_beginning_of_long_texts_are_left_out(spark):
    long = (FILL + " ") * 9
    assert len(long) > 5000
    with_refs = long + "\nReferences\n" + "tablature the " * 50
    assert "Tablature" not in [p for p, _ in found(spark, None, with_refs)]
    assert "Tablature" in [p for p, _ in found(spark, None, "References\n" + "tablature the " * 50 + FILL)]
    assert "Tablature" not in [p for p, _ in found(spark, None, "tablature the " * 50 + long * 7, most=200)]


def test_lists_are_parameters_and_odd_rows(spark):
    assert found(spark, None, "lute the " * 4 + FILL, generic=["lute"], stop=[]) == [("The", 4.0)]
    for body in (None, "", "1 2 3 " * 100):
        assert found(spark, "x", body) == []


def test_a_long_text_takes_time_by_its_words_alone(spark):
    """Thousands of words and phrases that all hold the one taken; each word used to be held against each phrase."""
    many = " ".join(f"lute{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(4000))
    found(spark, None, "lute the " * 100)  # begins Python
    began = time.time()
    assert found(spark, None, f"{many} " * 4 + "the lute " * 100) == [("Lute", 100.0)]
    assert time.time() - began < 8
