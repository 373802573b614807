"""Clustering under constraints: components that agree, by rounds of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators import skew
from folioscope.operators.components import connected_components, stored

#: Separates the parts of a key; stands for a field without values, and for any.
PART, NONE, ANY = "\u0001", "\u0002", "\u0003"


def _keys(fields: list[str], options) -> Column:
    """array<string>: for each field and each of its values a key for every choice of what ``options`` offers for the other fields."""
    of_field = []
    for k, f in enumerate(fields):
        keys = F.transform(f, lambda v: F.concat(F.lit(f"{k}{PART}"), v))  # noqa: B023
        for g in fields:
            if g != f:
                keys = F.flatten(F.transform(keys, lambda x: F.transform(options(g), lambda o: F.concat(x, F.lit(PART), o))))  # noqa: B023
        of_field.append(keys)
    return F.array_distinct(F.concat(*of_field))


def _agreed(nodes: DataFrame, fields: list[str], rounds: int = 60) -> tuple[DataFrame, list[DataFrame]]:
    """``comp`` and its values by field, and the merges ``a, b`` that led there.

    In each round every component looks for the smallest one that shares a value and agrees in all fields: keys of the shared
    value and of what the other fields may be find it by one join. A component whose smallest partner is itself takes in
    those that found it: all that bring nothing new to a field, and those that agree with the smallest of them where they do.
    """
    comps, merges = nodes, []
    none, any_ = F.array(F.lit(NONE)), F.array(F.lit(ANY))
    offered = lambda g: F.concat(F.when(F.size(g) > 0, F.col(g)).otherwise(none), any_)
    asked = lambda g: F.when(F.size(g) > 0, F.concat(F.col(g), none)).otherwise(any_)
    for _ in range(rounds):
        least = comps.select("comp", F.explode(_keys(fields, offered)).alias("key")).groupBy("key").agg(F.min("comp").alias("to"))
        asks = stored(comps.select("comp", F.explode(_keys(fields, asked)).alias("key")), "asks")
        best = stored(skew.lookup(asks, least, ["key"]).groupBy("comp").agg(F.min("to").alias("to")).where("to < comp"), "proposals")
        open_ = best.join(best.select(F.col("comp").alias("to")), "to", "left_anti")
        first = open_.groupBy("to").agg(F.min("comp").alias("first"))
        of = lambda name: [F.col(f).alias(f"{name}_{f}") for f in fields]
        host = first.join(comps.select(F.col("comp").alias("to"), *of("host")), "to").join(comps.select(F.col("comp").alias("first"), *of("first")), "first")
        guests = skew.lookup(stored(open_.join(comps, "comp"), "guests"), host, ["to"])
        fits = reduce(lambda x, y: x & y, [(F.size(f) == 0) | (F.size(f"host_{f}") > 0) | F.arrays_overlap(f, f"first_{f}") for f in fields])
        took = stored(guests.where(fits).select("comp", "to"), "took")
        if not took.limit(1).count():
            return comps, merges
        merges.append(took.select(F.col("comp").alias("a"), F.col("to").alias("b")))
        moved = comps.join(took, "comp", "left").select(F.coalesce("to", "comp").alias("comp"), *fields)
        comps = stored(moved.groupBy("comp").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_set(f)))).alias(f) for f in fields]), "agreed")
    raise RuntimeError(f"clusters did not settle in {rounds} rounds")


def _one(low: str, high: str) -> Column:
    """The only value there is, if there is one."""
    return F.when(F.col(low) == F.col(high), F.col(low))


def agreeing(items: DataFrame, fields: list[str], naming: list[str], weak: str) -> DataFrame:
    """``id, cluster`` (its smallest id) of ``items(id, fields: array<string>, weak: string)``.

    Items belong together if they share a value of a field and clash in none: two sides clash in a field if both have values
    and share none. So do chains of such items, but a cluster never takes in what clashes with it; of several that clash with
    each other, the smallest id decides. A side is named if it has values in a field of ``naming``. Where no value is
    shared, an equal ``weak`` joins an unnamed side to the only one that it fits and does not clash with; items without any
    value that fit nothing else are one cluster, and if they fit more than one they stay alone. Weak links are settled once all others
    are, so nothing depends on the order of arrival.

    Items with equal values are one from the start, so an album with a third of all items is one node; no group is one
    task's. A cluster's values stand in one row. Null and empty values do not count, null ids are left out, rows
    of one id are items that share it.
    """
    clean = lambda f: F.array_sort(F.array_distinct(F.filter(F.coalesce(f, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))))
    own = items.where("id is not null").select(F.col("id").cast("long").alias("id"), F.nullif(F.col(weak), F.lit("")).alias("weak"), *[clean(f).alias(f) for f in fields])
    own = stored(own.withColumn("h1", F.xxhash64(*fields)).withColumn("h2", F.xxhash64(F.lit(1), *reversed(fields))).withColumn("bare", F.concat(*fields) == F.array()), "items")
    nodes = stored(own.where("not bare").groupBy("h1", "h2").agg(F.min("id").alias("comp"), *[F.first(f).alias(f) for f in fields]), "signatures")
    # chains through one field alone cannot clash
    merges = []
    for f in fields:
        only = reduce(lambda x, y: x & y, [F.size(g) == 0 for g in fields if g != f], F.size(f) > 0)
        each = nodes.where(only).select("comp", F.explode(f).alias("v"))
        merges.append(each.join(each.groupBy("v").agg(F.min("comp").alias("to")), "v").where("to < comp").select(F.col("comp").alias("a"), F.col("to").alias("b")))
    begun = connected_components(reduce(DataFrame.union, merges)).select(F.col("id").alias("comp"), F.col("component_id").alias("to"))
    begun = stored(begun, "begun")
    start = nodes.join(begun, "comp", "left").select(F.coalesce("to", "comp").alias("comp"), *fields)
    start = stored(start.groupBy("comp").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_set(f)))).alias(f) for f in fields]), "agreed")
    comps, later = _agreed(start, fields)
    edges = reduce(DataFrame.union, [begun.where("to < comp").select(F.col("comp").alias("a"), F.col("to").alias("b")), *later])
    found = stored(connected_components(edges), "strong")
    group = stored(nodes.select("comp", "h1", "h2").join(found.withColumnRenamed("id", "comp"), "comp", "left").select("h1", "h2", F.coalesce("component_id", "comp").alias("group")), "groups")
    strong = stored(skew.lookup(own.where("not bare").select("id", "weak", "h1", "h2"), group, ["h1", "h2"]).select("id", "weak", "group"), "strong")
    named = reduce(lambda x, y: x | y, [F.size(f) > 0 for f in naming])
    rest = [f for f in fields if f not in naming]
    kept = reduce(lambda x, y: x | y, [F.size(f) > 0 for f in rest], F.lit(False))
    kinds = comps.select(F.col("comp").alias("group"), named.alias("named"), kept.alias("kept"))
    w = stored(strong.where("weak is not null").select("group", "weak").distinct().join(kinds, "group"), "weak")
    # a side with values but no name, and the only named side without values of its kind that it fits, if it fits no other
    if rest:
        a, b = w.where("named and not kept").select("group", "weak"), w.where("not named").select("group", "weak")
        only = lambda x, y: x.join(y.groupBy("weak").agg(F.min("group").alias("low"), F.max("group").alias("high")), "weak").groupBy("group").agg(F.min("low").alias("low"), F.max("high").alias("high")).select("group", _one("low", "high").alias("to")).where("to is not null")
        there, back = only(b, a), only(a, b).select(F.col("group").alias("to"), F.col("to").alias("group"))
        pairs = there.join(back, ["group", "to"])
        pairs = stored(pairs.select("group", F.least("group", "to").alias("into")).union(pairs.select(F.col("to"), F.least("group", "to"))), "pairs")
        strong = stored(skew.lookup(strong, pairs, ["group"]).withColumn("group", F.coalesce("into", "group")).drop("into"), "strong")
        w = strong.where("weak is not null").select("group", "weak").distinct()
    fits = w.groupBy("weak").agg(F.min("group").alias("low"), F.max("group").alias("high"))
    bare = own.where("bare").select("id", "weak")
    calls = bare.where("weak is not null").groupBy("weak").agg(F.min("id").alias("first")).join(fits, "weak", "left")
    calls = stored(calls.select("weak", "first", F.when(F.col("low").isNull(), F.col("first")).alias("own"), _one("low", "high").alias("group")), "calls")
    least = stored(strong.select("group", "id").union(calls.where("group is not null").select("group", F.col("first").alias("id"))).groupBy("group").agg(F.min("id").alias("cluster")), "least")
    called = calls.join(least, "group", "left").select("weak", F.coalesce("cluster", "own").alias("cluster"))
    out = skew.lookup(strong.select("id", "group"), least, ["group"]).select("id", "cluster")
    loose = skew.lookup(stored(bare, "bare"), called, ["weak"]).select("id", F.coalesce("cluster", "id").alias("cluster"))
    return out.unionByName(loose)


def constrained(items: DataFrame, block: str) -> DataFrame:
    """``id, cluster`` (smallest id) from items(id long, codes array<string>, weak string): ``agreeing`` by codes within each block."""
    within = lambda v: F.concat(F.coalesce(F.col(block).cast("string"), F.lit("")), F.lit(PART), v)
    i = items.select("id", F.transform(F.filter("codes", lambda v: v != ""), within).alias("codes"), F.when(F.col("weak") != "", within(F.col("weak"))).alias("weak"))
    return agreeing(i, ["codes"], ["codes"], "weak")


def absorbed(keys: DataFrame, key: str) -> DataFrame:
    """Batch keys with the shortest known key that begins them, word by word: ``key, batch``."""
    parts = F.split(key, " ")
    each = keys.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), " "))).alias("batch"))
    known = keys.select(F.col(key).alias("batch")).distinct()
    hit = each.join(known, "batch", "left_semi")
    return hit.groupBy(key).agg(F.min_by("batch", F.length("batch")).alias("batch"))
