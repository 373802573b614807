import pytest
from pyspark.sql import functions as F

from folioscope.functions import pages, rules
from folioscope.plans import catalogue, evidence  # noqa: F401  registers its queries in catalogue


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_catalogue_numbers_in_their_printed_forms(spark):
    want = {
        "Partita BWV Anh. 12": "BWV Anh.12", "bwv1013_flute": "BWV 1013", "BuxWV 149": "BuxWV 149", "HWV 56a": "HWV 56a", "RV. 580": "RV 580", "TWV 41:c2": "TWV 41:c2", "TWV 55 D 6": "TWV 55:D6", "TWV 1:1234": "TWV 1:1234",
        "QV 5 : 174": "QV 5:174", "SWV 22": "SWV 22", "Wq 22": "Wq.22", "KV 331": "K.331", "K. 467b": "K.467b", "k. 467": None, "Hob. XV.25": "Hob.XV:25", "Hob XVIIa : 4": "Hob.XVII:a4", "WoO 80": "WoO 80", "Z 860": "Z.860", "Z 5": None,
        "Op. 59, No. 2": "Op.59 No.2", "op.59 nº III": "Op.59 No.3", "Opus 131": "Op.131", "Op 5 № 4": "Op.5 No.4", "nothing": None, "BWV 5 Op. 7": "BWV 5",
    }
    want["Hob XVIIa : 4"] = "Hob.XVIIa:4"
    got = {r.t: r.n for r in table(spark, [(t,) for t in want], "t string").select("t", rules.catalogue_number(F.col("t")).alias("n")).collect()}
    assert got == want
    assert table(spark, [("RV 5 and Z. 12, Op. 3 No. 1; rv 5",)], "t string").select(rules.catalogue_numbers(F.col("t")).alias("n")).first().n == ["RV 5", "Z.12", "Op.3"]


def test_keys_series_and_runs(spark):
    keys = {"Sonate en la mineur": "A minor", "Concerto in sol maggiore": "G major", "Suite em si bemol menor": "B-flat minor", "Sonata c-moll": "C minor", "B-flat major": "B-flat major", "Fuga in F♯ minor": "F-sharp minor", "Sonata in G": None, "Sonata re fa": None, "Concerto ré majeur": "D major"}
    got = {r.t: r.k for r in table(spark, [(t,) for t in keys], "t string").select("t", rules.key_with_mode(F.col("t")).alias("k")).collect()}
    assert got == keys
    places = {"Suite No. 6": 6, "Concerto IV": 4, "Sonata Nr.12": 12, "Sinfonia nº 3": 3, "Sonate XI in G": 11, "Aria IV": None, "In No man's 5": None, "No5": 5}
    got = {r.t: r.k for r in table(spark, [(t,) for t in places], "t string").select("t", rules.serial_number(F.col("t")).alias("k")).collect()}
    assert got == places
    runs = {"Inventions, BWV 772-786": True, "BWV 846–869": True, "Anthems, 1700-1720": False, "K.1-5": False, "BWV 5": False, "Z. 860-999999": False}
    got = {r.t: r.k for r in table(spark, [(t,) for t in runs], "t string").select("t", rules.catalogued_run(F.col("t")).alias("k")).collect()}
    assert got == runs


def test_works_that_fit_a_title(spark):
    fits = [("Zadok", "Anthems, 1700-1720", True), ("Sonata in G", "Sonata in g", True), ("Sonata in G minor", "Sonata in G major", False), ("Prelude", "Preludes, BWV 846-869", False), ("Sonate en la mineur", "Sonata in A minor", True), ("Sonate en la mineur", "Sonata in C minor", False)]
    got = table(spark, fits, "t string, w string, x boolean").select("t", "w", pages.work_compatible(F.col("t"), F.col("w")).alias("x")).collect()
    assert [tuple(r) for r in got] == fits
    borne = [("Triosonate", "Sonata for two violins", None, True), ("Gavotte", "Orchestral Suite", "Ouverture\nGavotte I", True), ("Andante cantabile", "Quartet", "Moderato\nAndante cantabile e lento", True), ("Largo", "Concerto for flute", "Allegro", False), ("Wedding march", "Organ book", None, False), ("Wedding march", "Music for a wedding", None, True), (None, "Sonata", None, False)]
    got = table(spark, borne, "t string, w string, m string, x boolean").select("t", "w", "m", pages.work_plausible(F.col("t"), F.col("w"), F.col("m")).alias("x")).collect()
    assert [tuple(r) for r in got] == borne


def test_the_file_name_that_tells_more(spark):
    want = {"P-Cug MM 44 motet": 2 + 1 / 3, "1730 scan": 2, "17xx Bach Partita la m flauta BWV 1013.pdf": 2 + 3 + 1, "facsimile de partita de bach.pdf": 2 / 3, "scan copy page": 0}
    got = {r.t: r.n for r in table(spark, [(t,) for t in want], "t string").select("t", rules.name_information(F.col("t")).alias("n")).collect()}
    assert {t: round(n, 6) for t, n in got.items()} == {t: round(n, 6) for t, n in want.items()}
    best = spark.range(1).select(pages.best_name(F.array(F.lit("1730 scan"), F.lit("P-Cug MM 44 motet"))).alias("b")).first().b
    assert best == "P-Cug MM 44 motet"


@pytest.mark.parametrize("name", ["work_vetoes", "notation_names"])
def test_rows_of_one_file_are_dealt_over_tasks(spark, sf, name):
    out = catalogue.QUERIES[name](spark, sf)
    assert out.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["library_sigla", "key_duplicates_compat"])
def test_texts_are_read_once(spark, sf, name):
    """What is worked out of the texts is stored; all joins start from there."""
    assert "documents.parquet" not in catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
