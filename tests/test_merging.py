import random

import duckdb
from pyspark.sql import functions as F

from folioscope.operators import merging
from folioscope.plans import merges as queries
from folioscope.plans.catalogue import ORACLE_SQL
from tests.compare import compared


def plain(pairs):
    """Follows each record to its end; in a circle, to the smallest of all that lead into it."""
    to = {}
    for d, k in sorted(p for p in pairs if None not in p and p[0] != p[1]):
        to.setdefault(d, k)
    ends, circles = {}, {}
    for start in to:
        x = start
        for _ in to:
            x = to.get(x, x)
        if x in to:  # it goes round
            circle = [x]
            while to[circle[-1]] != x:
                circle.append(to[circle[-1]])
            circles.setdefault(min(circle), []).append(start)
        else:
            ends[start] = x
    ends |= {i: min(led) for led in circles.values() for i in led}
    return {d: k for d, k in ends.items() if d != k}


def test_maps_of_merges_equal_a_plain_loop(spark):
    random.seed(3)
    pairs = [(i, i + 1) for i in range(1, 6)] + [(20, 21), (21, 22), (22, 20), (25, 21), (30, 30), (31, None), (None, 3), (40, 41), (40, 39)] + [(random.randrange(100, 160), random.randrange(100, 160)) for _ in range(40)]
    got = {r.dropped: r.kept for r in merging.resolved(spark.createDataFrame(pairs, "dropped long, kept long").repartition(3)).collect()}
    assert got == plain(pairs) and got[1] == 6 and got[25] == 20
    busy = {r.dropped: r.kept for r in merging.resolved(spark.createDataFrame(pairs, "dropped long, kept long"), spark.createDataFrame([(3,), (22,)], "id long")).collect()}
    assert busy == {d: k for d, k in got.items() if d > 30}


def test_chains_keep_names_tags_notes_and_references(spark):
    records = spark.createDataFrame([(1, "one", ["a", "b"], "x"), (2, "", None, "see #1 and #0004"), (3, None, ["c", "a"], "#2, #1, #99 #5"), (4, "four", ["d"], None), (5, "five", [], "nothing")], "id long, name string, tags array<string>, memo string")
    notes = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (13, 4), (14, None), (15, 77)], "note int, id long")
    merges = spark.createDataFrame([(1, 2), (2, 3), (4, 88), (89, 5)], "dropped long, kept long")
    out, moved = merging.merge_records(records, merges, notes, "id", ["name"], ["tags"], ["memo"])
    assert {r.id: (r.name, r.tags, r.memo) for r in out.collect()} == {3: ("one", ["c", "a", "b"], "#0003, #0003, #99 #5"), 4: ("four", ["d"], None), 5: ("five", [], "nothing")}
    assert {r.note: r.id for r in moved.collect()} == {10: 3, 11: 3, 12: 3, 13: 4, 14: None, 15: 77}
    assert merging.resolved(merges.limit(0)).count() == 0


def test_parts_split_off(spark):
    records = spark.createDataFrame([(1, [("a/x.pdf", "Violin"), ("a/y.pdf", None)], "t"), (7, [("b.pdf", " ")], "u"), (8, None, "v")], "id long, extras array<struct<file: string, label: string>>, type string")
    parts = spark.createDataFrame([(1, "a/x.pdf"), (1, "a/x.pdf"), (7, "b.pdf"), (7, "a/y.pdf"), (9, "q")], "id long, file string")
    kept, new = merging.split_off(records, parts, "id", "extras", "title", {"type": F.col("type"), "state": F.lit("to review")})
    assert {tuple(r) for r in new.collect()} == {(8 + 1, "Violin", "a/x.pdf", "t", "to review"), (10, "b.pdf", "b.pdf", "u", "to review")}
    assert {r.id: r.extras and [x.file for x in r.extras] for r in kept.collect()} == {1: ["a/y.pdf"], 7: [], 8: None}


def test_balances_of_minus_zero_and_missing_ones_are_groups_as_in_sql(spark, tmp_path):
    rows = [(0, 5.0), (1, -0.0), (2, 0.0), (3, -0.0), (4, 7.0), (5, None), (6, -1.0), (7, None), (8, float("nan"))]
    values = ", ".join(f"({k}, {0 if k != 7 else 1}, {'NULL' if b is None else f"CAST('{b}' AS DOUBLE)"})" for k, b in rows)
    con = duckdb.connect()
    con.sql(f"SELECT CAST(k AS BIGINT) AS c_custkey, 'C' || k AS c_name, CAST(n AS INTEGER) AS c_nationkey, b AS c_acctbal, 'S' AS c_mktsegment FROM (VALUES {values}) AS t(k, n, b)").write_parquet(f"{tmp_path}/customer.parquet")
    con.sql("SELECT CAST(i AS BIGINT) AS o_orderkey, CAST(i % 9 AS BIGINT) AS o_custkey FROM range(20) AS t(i)").write_parquet(f"{tmp_path}/orders.parquet")
    for f in (queries.records_merged, queries.references_rewritten):
        compared(spark, tmp_path, f.__name__, f, ORACLE_SQL[f.__name__])


def test_splitting_moves_records_once(spark):
    """Records and their parts are met once; an unnamed file stays where it is."""
    rows = [(1, "a", [("x/f.pdf", " L "), ("x/f.pdf", " L "), (None, "n"), ("g", "")]), (2, "b", [("g", "")]), (3, "c", None)]
    recs = spark.createDataFrame(rows, "k long, w string, extras array<struct<file: string, label: string>>")
    parts = spark.createDataFrame([(1, "x/f.pdf"), (1, "x/f.pdf"), (2, "h"), (9, "g"), (3, "g"), (None, "g")], "k long, file string")
    kept, new = merging.split_off(recs, parts, "k", "extras", "title", {"w": F.col("w")})
    assert {r.k: r.extras and [x.file for x in r.extras] for r in kept.collect()} == {1: [None, "g"], 2: ["g"], 3: None}
    assert [tuple(r) for r in new.select("k", "title", "file", "w").collect()] == [(4, "L", "x/f.pdf", "a")]
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
