import random

from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import inverted, search
from folioscope.streaming import ingest

COLUMNS = {"title": 10.0, "body": 1.0}
SCHEMA = "id long, title string, body string, at int, gone boolean"


def batch(seed, ids):
    random.seed(seed)
    words = ["alpha", "beta", "alphabet", "gamma", "Ünïcode", "beta,gamma", "delta"]
    make = lambda n: " ".join(random.choice(words) for _ in range(random.randrange(n)))
    return [(i, make(4), make(30), seed, False) for i in ids]


def test_search_over_segments_equals_the_scan(spark, tmp_path, monkeypatch):
    """Batches with updates and deletions, a batch run twice, and merges of segments."""
    monkeypatch.setattr(inverted, "FAN", 2)
    index = inverted.Index(spark, f"file://{tmp_path}/index", "id", list(COLUMNS))
    live, merged = {}, False
    batches = [batch(1, range(40)), batch(2, range(30, 60)) + [(5, "", "", 2, True), (5, "alpha", "alpha beta", 1, False)], [(i, None, None, 3, True) for i in range(0, 60, 7)] + [(None, "alpha", "x", 3, False)], batch(4, range(0, 20)), batch(5, [3, 3, 99])]
    for version, rows in enumerate(batches, 1):
        index.add(spark.createDataFrame(rows, SCHEMA), version, updated="at", deleted="gone")
        index.add(spark.createDataFrame(rows[:1], SCHEMA), version, updated="at", deleted="gone")  # run again: passed over
        newest = {}
        for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[3], r[4], r[1] or "", r[2] or "")):
            newest[r[0]] = r
        live |= newest
        live = {i: r for i, r in live.items() if not r[4]}
        docs = spark.createDataFrame(list(live.values()), SCHEMA)
        for q in ('"beta gamma" delta', "beta-ga alph", "unicode")[: 1 + version // 2]:
            want = search.ranked(docs, COLUMNS, search.compile_query(q), 25, "id").select("id", "score", "rank")
            assert sorted(map(tuple, index.ranked(COLUMNS, search.compile_query(q), 25).collect())) == sorted(map(tuple, want.collect())), (version, q)
        merged |= any(n.startswith("m") for n, _ in index._manifest()[2])
    df = docs.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), text.tokens(F.coalesce(c, F.lit(""))).alias("t")) for c in COLUMNS])).alias("x")).select("id", "x.field", F.explode("x.t").alias("token"))
    want = {(r.token, r.field): r.n for r in df.groupBy("token", "field").agg(F.count_distinct("id").alias("n")).collect()}
    assert {(r.token, r.field): r.n for r in index.frequencies().collect()} == want
    assert merged and {r.key for r in index.records().collect()} == set(live)


def test_empty_index_and_empty_batch(spark, tmp_path):
    index = inverted.Index(spark, f"file://{tmp_path}/index", "id", ["title"])
    assert index.ranked({"title": 1.0}, search.compile_query("alpha")).count() == 0
    index.add(spark.createDataFrame([], SCHEMA))
    index.add(spark.createDataFrame([(1, "Alpha", "", 1, False)], SCHEMA))
    assert [r.id for r in index.ranked({"title": 1.0}, search.compile_query("alph")).collect()] == [1]


def test_stream_of_changes(spark, tmp_path):
    """Each file is a batch; a stream that begins again from its checkpoint goes on where it was."""
    index = inverted.Index(spark, f"file://{tmp_path}/index", "id", ["title"])
    for rows in ([(1, "alpha", "", 1, False), (2, "alpha beta", "", 1, False)], [(2, "gamma", "", 2, False)], [(1, None, None, 3, True), (3, "alpha", "", 3, False)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ingest.watched(spark, f"{tmp_path}/in", SCHEMA, "parquet")
        run = ingest.maintain_postings(stream, index, f"{tmp_path}/checkpoint", "at", "gone")
        run.processAllAvailable()
        run.stop()
    assert [r.id for r in index.ranked({"title": 1.0}, search.compile_query("alpha")).collect()] == [3]
    assert {(r.token, r.n) for r in index.frequencies().collect()} == {("alpha", 1), ("gamma", 1)}


def test_postings_are_made_where_texts_are_read(spark, tmp_path):
    """One file for each part, sorted by token; a record without words, and a deletion, are postings of the empty word; nothing else is kept of a record."""
    index = inverted.Index(spark, f"file://{tmp_path}/index", "id", ["title", "body"])
    rows = [(i, "beta alpha beta", f"Zeta {i}", 1, False) for i in range(200)] + [(200, "?!", None, 1, False), (201, "alpha", "x", 1, True)]
    index.add(spark.createDataFrame(rows, SCHEMA), deleted="gone")
    parts = sorted((tmp_path / "index" / "parts" / "segment=s1").glob("part=*"))
    assert len(parts) > 50 and all(len(list(p.glob("*.parquet"))) == 1 for p in parts)
    for p in parts[:3]:
        found = [(r.token, r.field, r.key) for r in spark.read.schema("token string, field string, key long").parquet(f"file://{p}").coalesce(1).collect()]
        assert found == sorted(found)
    assert not (tmp_path / "index" / "records").exists()
    got = {(r.token, r.field): r.positions for r in spark.read.parquet(f"file://{tmp_path}/index/parts/segment=s1").where("key = 7").collect()}
    assert got == {("", ""): [5], ("alpha", "title"): [1], ("beta", "title"): [0, 2], ("zeta", "body"): [0], ("7", "body"): [1]}
    assert sorted((r.key, r.deleted, r.len) for r in index._records(["s1"]).where("key > 198").collect()) == [(199, False, 5), (200, False, 0), (201, True, 0)]
