from folioscope.operators import sigla

KNOWN = [("P-Cug", "Coimbra"), ("P-Cua", "Coimbra"), ("P-Ln", "Lisboa"), ("D-LEb", "Leipzig"), ("D-LEmi", "Leipzig"), ("D-B", "Berlin"), ("GB-Lbl", "London"), ("I-MOe", "Módena"), ("P-Coimbra", None), (None, "Nowhere")]


def test_full_abbreviated_and_by_city(spark):
    known = spark.createDataFrame([*KNOWN, KNOWN[0], ("D-Wiesbaden", "Wiesbaden"), ("D-Wismar", "Wismar")], "siglum string, city string")
    asked = [(1, "P-Cug"), (2, "D-LEi"), (3, "D-LE"), (4, "modena"), (5, "Coimbra"), (6, "D-Wsbn"), (7, "D-Wisb"), (8, "D-Wis"), (9, "F-Cug"), (10, None), (11, ""), (12, " GB-Lbl "), (13, "P-Cmb"), (14, "P-Coba"), (14, "P-Coba"), (15, "D-Wimr")]
    got = {r.id: (r.siglum, r.step) for r in sigla.libraries(spark.createDataFrame(asked, "id int, name string"), known).collect()}
    assert got == {1: ("P-Cug", 0), 2: ("D-LEmi", 1), 4: ("I-MOe", 2), 7: ("D-Wiesbaden", 1), 12: ("GB-Lbl", 0), 14: ("P-Coimbra", 1), 15: ("D-Wismar", 1)}


def test_sources_by_shelfmark(spark):
    known = spark.createDataFrame([("a", "P-Cug", "MM 48"), ("b", "P-Cug", "MM. 9"), ("c", "P-Cug", "M.M. 9"), ("d", "P-Ln", "MM 48"), ("e", "P-Ln", "C.I.C. 007"), ("f", "P-Ln", None)], "source string, siglum string, shelfmark string")
    asked = spark.createDataFrame([(1, "P-Cug", "mm  48"), (2, "P-Cug", "MM.48"), (3, "P-Cug", "MM9"), (4, "P-Ln", "CIC 7"), (5, "P-Ln", "MM 49"), (6, None, "MM 48"), (7, "P-Cug", None), (8, "P-Cug", "MM 9")], "id int, siglum string, shelfmark string")
    got = {r.id: (r.source, r.step) for r in sigla.sources(asked, known).collect()}
    assert got == {1: ("a", 0), 2: ("a", 1), 4: ("e", 3), 8: ("b", 1)}
