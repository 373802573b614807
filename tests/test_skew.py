import random

from pyspark.sql import functions as F

from folioscope.operators import skew
from folioscope.plans import archive
from folioscope.plans.catalogue import ORACLE_SQL
from tests.compare import compared


def test_lookup_of_heavy_light_null_and_missing_keys(spark):
    rows = [(7 if i % 3 == 0 else None if i % 50 == 1 else 9 if i % 3 == 1 else i, i) for i in range(6000)]
    left = spark.createDataFrame(rows, "k long, v int")
    right = spark.createDataFrame([(7, "seven"), *[(i, f"n{i}") for i in range(2, 6000, 6)]], "k long, name string")
    names = dict(right.collect())
    got = sorted(map(tuple, skew.lookup(left, right, ["k"]).select("k", "v", "name").collect()), key=lambda r: r[1])
    assert got == [(k, v, names.get(k)) for k, v in rows]
    assert skew.lookup(left.limit(0), right, ["k"]).count() == 0


def test_running_values_of_a_key_that_goes_over_many_ranges(spark):
    random.seed(3)
    rows = [(0 if i % 3 else i % 40, i, random.getrandbits(40)) for i in range(3000)]
    want, n, x = {}, {}, {}
    for k, i, v in rows:
        n[k], x[k] = n.get(k, 0) + 1, x.get(k, 0) ^ v
        want[i] = (n[k], x[k])
    random.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows make one range
    parts = skew.dealt(spark.createDataFrame(rows, "k long, i long, v long").repartition(8), "k", [F.col("i")])
    got = skew.running(parts, "k", [F.col("i")], {"n": (F.count, F.col("v"), skew.added), "x": (F.bit_xor, F.col("v"), skew.mixed)})
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts.select("__p").distinct().count() > 1
    assert {r.i: (r.n, r.x) for r in got.collect()} == want


def test_items_are_not_dealt_by_their_few_keys(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on tables too large for it
    try:
        plan = archive.shortening_key_lookup(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin [key" in plan and "hashpartitioning(key" not in plan
    compared(spark, sf, "shortening_key_lookup", archive.shortening_key_lookup, ORACLE_SQL["shortening_key_lookup"])
