import pytest
from pyspark.sql import functions as F

from folioscope.functions import evidence
from folioscope.operators import clusters, merging, registry
from folioscope.plans import workflows
from tests.test_functions import one


def test_evidence(spark):
    s = lambda f, *v: one(spark, f(*[F.lit(x) for x in v]))
    assert s(evidence.titles_compatible, "red book of songs", "songs red") and not s(evidence.titles_compatible, "red book", "blue sea")
    assert s(evidence.core_title, "Suite (for lute) BWV 995 in G") == "suite in g"
    assert s(evidence.label_number, "Stereo ABC 123 45 - 1999") == "ABC 123 45"[:10] or s(evidence.label_number, "Stereo ABC 12345") == "ABC 12345"
    assert s(evidence.rights_year, "℗ 1987 Label") == 1987 and s(evidence.medium, "recorded on CD in mono") == "cd"
    assert [tuple(x) for x in s(evidence.library_ids, "see ark:/12148/btv1b and bsb00012345")] == [("ark", "ark:/12148/btv1b"), ("bsb", "bsb00012345")]
    assert s(evidence.dating, "1. Viertel 17. Jh.") == "1601-1625" and s(evidence.dating, "2nd half 18th century") == "1751-1800" and s(evidence.dating, "1750") is None
    assert s(evidence.useful_title, "A study of bells") and not s(evidence.useful_title, "Microsoft Word - x.doc")
    assert s(evidence.plausible_title, "Missa") and not s(evidence.plausible_title, "glo - ri - a in")
    assert s(evidence.edition_confirmed, 1999, 2000, "AB 1", "ab-1", None, None) == "confirmed" and s(evidence.edition_confirmed, 1999, 2005, "AB 1", "AB 1", None, None) == "denied"
    assert s(evidence.corrections, "A title /", "[s.n.]", "Porto") == {"title": "A title", "publisher": ""}
    assert one(spark, evidence.joined_lines(F.array(F.lit("one"), F.lit("two."), F.lit("three"), F.lit("")))) == ["one two.", "three"]
    assert s(evidence.verified, "A", "a", "Doe", "doe") == "confirmed" and s(evidence.verified, "A", None, "Doe", None) == "not found"


def test_clusters(spark):
    rows = [("f", 1, ["x"], "t|p"), ("f", 2, None, "t|p"), ("f", 3, ["y"], "t|p"), ("f", 4, ["y", "z"], None), ("f", 5, ["z", "x"], None), ("g", 6, None, "t|p")]
    items = spark.createDataFrame(rows, "folder string, id long, codes array<string>, weak string")
    assert dict(clusters.constrained(items, "folder").collect()) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6}
    keys = spark.createDataFrame([("a",), ("a b",), ("c d e",), ("c d",)], "key string")
    assert dict(clusters.absorbed(keys, "key").collect()) == {"a": "a", "a b": "a", "c d e": "c d", "c d": "c d"}


def test_registry(spark):
    t = registry.RecordType("score", "musical_score", "primary")
    for _ in range(2):
        t.add(registry.Field("n", "Number", "number"))
        t.add(registry.Field("k", "Kind", options=("a", "b")))
    assert len(t.fields) == 2
    with pytest.raises(ValueError):
        t.add(registry.Field("x", "X", "matrix"))
    df = spark.createDataFrame([({"n": "12", "k": "c", "z": "1"},)], "m map<string,string>")
    r = df.select(*registry.typed(F.col("m"), t), registry.invalid_keys(F.col("m"), t).alias("bad")).first()
    assert (r.n, r.k, r.bad) == (12.0, "c", ["z", "k"])
    c = registry.candidates_of(df, "cat", F.lit(0.9), title=F.lit("T"), publisher=F.lit("[s.n.]")).first()
    assert (c.source, c.title, c.publisher, c.doi) == ("cat", "T", None, None)


def test_workflows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("title", F.split_part("text", F.lit("\n"), F.lit(1)))
    hits = workflows.search_with_facets(docs, {"title": 10.0, "text": 1.0}, "thon", F.col("lang") == "en").collect()
    assert hits and [r.rank for r in hits] == sorted(r.rank for r in hits) and {r.lang for r in hits} == {"en"}
    assert workflows.search_with_facets(docs, {"title": 10.0, "text": 1.0}, "#3", F.lit(True)).first().doc_id == 3
    entry = "id long, title string, date string, doi string, isbn string"
    new = spark.createDataFrame([(1, "A first title here", "1999", None, None), (2, "A First Title, Here", "1999", None, None), (3, "Other", None, "10.1/X", None), (4, "Unknown thing", None, None, None)], entry)
    lib = spark.createDataFrame([(7, "whatever", None, "10.1/x ", None), (8, "a first title here", "1950", None, None)], entry)
    assert {r.entry: (r.action, r.match) for r in workflows.import_entries(new, lib).collect()} == {1: ("new", None), 2: ("folded", 1), 3: ("duplicate", 7), 4: ("new", None)}
    prints = spark.createDataFrame([(1, "g", "0000000000"), (2, "g", "0000000001"), (3, "g", "0000000111"), (4, "g", "1111111111")], "id long, g string, bits string")
    points = spark.createDataFrame([(1, 5), (2, 9), (3, 1), (4, 1)], "id long, points int")
    groups, doubtful = workflows.near_duplicates(prints, 10, 1, 3, "g", points)
    assert {(r.id, r.keeper) for r in groups.collect()} == {(1, 2), (2, 2)} and {(r.a, r.b) for r in doubtful.collect()} == {(1, 3), (2, 3)}
    cand = spark.createDataFrame([(1, 1, 0, "s", 0.9, "A", "1999", None, "", "w"), (1, 2, 1, "s", 0.9, "A", "1999", None, "P", "w"), (1, 3, 2, "t", 0.88, "A", "1999", None, "Q", "w")], "q long, id long, arrival int, source string, confidence double, title string, date string, doi string, publisher string, work string")
    got = workflows.enrich(cand, "q", "work", {"no": F.lit(False)}, ["publisher"]).first()
    assert (got.winner, got.decision, got.publisher) == (1, "accepted", "Q")
    rec = spark.createDataFrame([(1, "", ["a"]), (2, "P", ["b"]), (3, "R", ["c"])], "id long, publisher string, tags array<string>")
    notes = spark.createDataFrame([(2, "n")], "id long, note string")
    after, moved = merging.merge_records(rec, spark.createDataFrame([(2, 1)], "dropped long, kept long"), notes, "id", ["publisher"], ["tags"])
    assert {(r.id, r.publisher, tuple(r.tags)) for r in after.collect()} == {(1, "P", ("a", "b")), (3, "R", ("c",))} and moved.first().id == 1
    work = "id long, title string, surname string, date string"
    a = spark.createDataFrame([(1, "Mass for four voices", "Cardoso", "1625"), (2, "Something else entirely", "X", None)], work)
    b = spark.createDataFrame([(9, "Mass for four voices", "Cardoso, M.", "1625-01"), (8, "Mass for four voices", "Cardoso", "1700")], work)
    assert [tuple(r) for r in workflows.existing_work(a, b).collect()] == [(1, 9)]
    edit_in = spark.createDataFrame([(1, "", "review"), (2, "", "processing"), (3, "z", "review")], "id long, place string, state string")
    out, audit = workflows.bulk_edit(edit_in, {"place": ("only-if-empty", "Porto")}, [1, 2, 3], ["place"])
    assert {r.id: r.place for r in out.collect()} == {1: "Porto", 2: "", 3: "z"} and {r.id: r.action for r in audit.collect()} == {1: "changed", 2: "skipped", 3: "same"}
    files = spark.createDataFrame([("a", "h1"), ("b", "h2")], "path string, sha256 string")
    assert {r.path: r.state for r in workflows.space_audit(files, files.where("path = 'a'")).collect()} == {"a": "safe", "b": "to check"}


def test_ingest_of_odd_files(spark):
    files = lambda *rows: spark.createDataFrame(list(rows), "path string, sha256 string, size long, text string")
    library = spark.createDataFrame([(5, None), (7, "h"), (6, "h")], "id long, sha256 string")
    catalogue = spark.createDataFrame([(1, "10.1000/A", None, None, None), (2, "10.1000/a", "Two", "Roe", 1990), (3, None, "A long enough title", "Doe", 1999)], "id long, doi string, title string, surname string, year int")
    rows = workflows.ingest_files(
        files(("a/x.pdf", "h", 9, None), ("a/y.pdf", None, 9, "doi:10.1000/a"), ("a/(2001) A long enough title.pdf", "n", 9, ""), ("a/A long enough title.pdf", "n", 9, None), ("a/A long enough title.pdf", "n", 9, None), (None, "h", None, None), ("a/s.jpg", "h", 10, None)),
        library, catalogue,
    ).collect()
    got = sorted((r.path or "", r.action, r.match or 0, r.file_name or "") for r in rows)
    assert got == [
        ("", "ignored", 0, ""), ("a/(2001) A long enough title.pdf", "review", 0, ""), ("a/A long enough title.pdf", "filed", 3, "DOE_1999_a-long-enough-title"), ("a/A long enough title.pdf", "filed", 3, "DOE_1999_a-long-enough-title"),
        ("a/s.jpg", "ignored", 0, ""), ("a/x.pdf", "duplicate", 6, ""), ("a/y.pdf", "filed", 1, "_0000_"),
    ]
    assert workflows.ingest_files(files(), library.limit(0), catalogue.limit(0)).count() == 0
