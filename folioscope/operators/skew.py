"""Joins and running values that no hot key can slow down."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.components import stored

#: A key is heavy if it has more than this part of all rows; so there are fewer than this many heavy keys, whatever the input.
HEAVY = 1024


def lookup(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``left`` with the columns of ``right``, which has each key once (left join).

    Rows of heavy keys meet their row of ``right`` by broadcast (under ``HEAVY`` rows), all others by a shuffle in which no
    key has more than 1 / ``HEAVY`` of the rows. ``left`` is read three times, so it should be stored. Null keys meet nothing.
    """
    total = left.count()
    heavy = left.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") * HEAVY > total).drop("__n")
    hot = stored(heavy.join(right, on, "left"), "hot")
    return left.join(F.broadcast(hot), on).unionByName(left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right, on, "left"))


def dealt(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``df`` stored in ranges of key and order, with the number ``__p`` of each row's range: what ``running`` reads. A hot key lies in many ranges."""
    return stored(df.repartitionByRange(F.col(key), *order).withColumn("__p", F.spark_partition_id()), "ranges")


def running(parts: DataFrame, key: str, order: list[Column], values: dict[str, tuple[Callable[[Column], Column], Column, Callable[[Column, Column], Column]]]) -> DataFrame:
    """``parts`` (from ``dealt``) with running values within each key, up to and with the row: name -> (aggregate, value, how two parts' values combine).

    Each range runs through its own rows; a key that goes over several ranges carries its earlier ranges' values on. There
    are fewer such carries than ranges, so they are broadcast. Rows that tie in ``order`` must be equal.
    """
    inside = Window.partitionBy("__p", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.withColumns({name: agg(value).over(inside) for name, (agg, value, _) in values.items()})
    each = parts.groupBy(key, "__p").agg(*[agg(value).alias(f"__{name}") for name, (agg, value, _) in values.items()])
    before = Window.partitionBy(key).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carry = each.withColumns({f"__{name}": agg_of(combine)(F.col(f"__{name}")).over(before) for name, (_, _, combine) in values.items()} | {"__before": F.count("*").over(before)})
    carry = carry.where("__before > 0").drop("__before")
    out = out.join(F.broadcast(carry), [key, "__p"], "left")
    return out.withColumns({name: F.when(F.col(f"__{name}").isNull(), F.col(name)).otherwise(combine(F.col(name), F.col(f"__{name}"))) for name, (_, _, combine) in values.items()}).drop(*[f"__{name}" for name in values])


def added(a: Column, b: Column) -> Column:
    return a + b


def mixed(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def agg_of(combine: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    """The aggregate over parts that belongs to a way to combine two of them."""
    return {added: F.sum, mixed: F.bit_xor}[combine]
