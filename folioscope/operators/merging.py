"""Records merged into others and parts split off from them: maps of merges, moved notes, rewritten references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import skew
from folioscope.operators.components import connected_components, stored
from folioscope.operators.grouping import running_total


def resolved(merges: DataFrame, busy: DataFrame | None = None) -> DataFrame:
    """``dropped, kept`` with ``kept`` a record that stays, from ``merges(dropped, kept)`` in which it may be dropped itself.

    Chains lead to their end; a circle has none, so the smallest id of all that lead into it stays. Of several merges of one
    record the one into the smallest id counts. Merges into itself and with nulls do not count. All merges that are tied to
    a record of ``busy(id)`` are left undone.
    """
    m = merges.select(F.col("dropped").cast("long").alias("dropped"), F.col("kept").cast("long").alias("kept")).where("dropped <> kept")
    m = stored(m.groupBy("dropped").agg(F.min("kept").alias("kept")), "merges")
    found = stored(connected_components(m.select(F.col("dropped").alias("a"), F.col("kept").alias("b"))), "merged")
    # a component of such a map has one end or one circle
    ends = m.select(F.col("kept").alias("id")).distinct().join(m.select(F.col("dropped").alias("id")), "id", "left_anti")
    last = found.join(ends, "id").select("component_id", F.col("id").alias("end"))
    if busy is not None:
        tied = found.join(busy.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi").select("component_id").distinct()
        found = stored(skew.lookup(found, tied.withColumn("tied", F.lit(True)), ["component_id"]).where("tied is null").drop("tied"), "merged")
    out = skew.lookup(found, last, ["component_id"]).select(F.col("id").alias("dropped"), F.coalesce("end", "component_id").alias("kept"))
    return stored(out.where("dropped <> kept"), "merges")


def merge_records(records: DataFrame, merges: DataFrame, notes: DataFrame, key: str, fields: list[str], arrays: list[str], references: list[str] | None = None, busy: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, notes) after ``merges(dropped, kept)``, which are ``resolved`` first.

    Empty fields of a record that stays take the first value there is among those dropped into it, by id; arrays are joined in
    that order, each value once; notes are moved. ``#n`` in the columns ``references`` of the records that stay leads to what n became.
    A merge into a record that does not exist is left undone; so is one of a record that does not exist. Other columns stay.
    """
    there = records.select(F.col(key).cast("long").alias("id"))
    final = stored(resolved(merges.join(there.select(F.col("id").alias("kept")), "kept", "left_semi").join(there.select(F.col("id").alias("dropped")), "dropped", "left_semi"), busy), "final")
    root = final.select(F.col("dropped").alias(key), F.col("kept").alias("__to"))
    known = stored(records.join(root, key, "left"), "records")
    given = known.where("__to is not null")
    value = lambda f: F.min(F.when(~text.is_blank(F.col(f)), F.struct(key, f)))[f].alias(f"__{f}")
    joined = lambda a: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(key, F.coalesce(a, F.array()).alias("v")))), lambda x: x["v"]))).alias(f"__{a}")
    more = given.groupBy(F.col("__to").alias(key)).agg(F.count("*").alias("__n"), *[value(f) for f in fields], *[joined(a) for a in arrays])
    left = known.where("__to is null").drop("__to").join(more, key, "left")
    new = {f: text.first_filled(F.col(f), F.col(f"__{f}")) for f in fields} | {a: F.array_union(F.coalesce(a, F.array()), F.coalesce(f"__{a}", F.array())) for a in arrays}
    left = left.withColumns(new).select(*records.columns)
    for c in references or []:
        left = rewritten(left, key, c, final)
    return left, skew.lookup(notes, root, [key]).withColumn(key, F.coalesce("__to", key)).select(*notes.columns)


def rewritten(records: DataFrame, key: str, column: str, final: DataFrame) -> DataFrame:
    """``records`` with each ``#n`` of ``column`` replaced by the number of the record that n was merged into (four digits at least)."""
    number = r"#(\d{1,18})"
    records = stored(records, "records")
    asks = records.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(number), F.lit(1)))).alias("n")).withColumn("dropped", F.col("n").cast("long"))
    answers = skew.lookup(stored(asks, "references"), final, ["dropped"]).where("kept is not null")
    to = answers.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("n", F.lpad(F.col("kept").cast("string"), F.greatest(F.lit(4), F.length(F.col("kept").cast("string"))), F.lit("0"))))).alias("__map"))
    out = records.join(to, key, "left")
    pieces, numbers = F.split(column, number, -1), F.regexp_extract_all(F.col(column), F.lit(number), F.lit(1))
    new = F.array_join(F.zip_with(pieces, numbers, lambda p, n: F.concat(F.coalesce(p, F.lit("")), F.when(n.isNull(), "").otherwise(F.concat(F.lit("#"), F.coalesce(F.element_at("__map", n), n))))), "")
    return out.withColumn(column, F.when(F.col("__map").isNull(), F.col(column)).otherwise(new)).drop("__map")


def split_off(records: DataFrame, parts: DataFrame, key: str, extras: str, title: str, made: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(records, new records) after parts(key, file) are taken out of ``extras: array<struct<file, label>>`` and get records of their own.

    A new record has the next free number, the part's label (or the name of its file) as title, what ``made`` says of its old
    record, and the file; the rest is null. Parts that no record has are left out; a part asked for twice is taken once.
    """
    asked = parts.select(F.col(key), F.col("file").alias("__f")).groupBy(key).agg(F.collect_set("__f").alias("__asked"))
    both = stored(records.join(asked, key, "left"), "records")  # the one time that parts are moved to their records
    gone = lambda x: F.coalesce(F.array_contains("__asked", x["file"]), F.lit(False))
    about = {n: c.alias(f"__m{i}") for i, (n, c) in enumerate(made.items())}
    taken = both.where("__asked is not null").select(F.col(key).alias("__old"), *about.values(), F.explode(F.filter(extras, gone)).alias("__x"))
    label = F.coalesce(F.nullif(F.trim("__x.label"), F.lit("")), F.regexp_extract("__x.file", r"([^/]+)$", 1))
    new = taken.select("__old", label.alias(title), "__x.file", *[F.col(f"__m{i}").alias(n) for i, n in enumerate(made)]).dropDuplicates(["__old", "file"])
    last = both.agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).scalar()
    new = running_total(new.withColumn("__at", F.struct("__old", "file")), F.col("__at").asc(), F.lit(1))
    new = new.select((last + F.col("before") + 1).alias(key), title, "file", *made)
    kept = both.withColumn(extras, F.when(F.col("__asked").isNull(), F.col(extras)).otherwise(F.filter(extras, lambda x: ~gone(x))))
    return kept.select(*records.columns), new
