"""Sessions, batches and groups of files and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.components import stored


def sessions(df: DataFrame, by: str, ts: str, tie: str, gap_seconds: int) -> DataFrame:
    """``session`` (from 1) within each ``by``: a new one after a pause of the gap or longer."""
    over = f"over (partition by {by} order by {ts}, {tie})"
    new = F.expr(f"case when timestampdiff(microsecond, lag({ts}) {over}, {ts}) >= {gap_seconds * 1_000_000} or lag({ts}) {over} is null then 1 else 0 end")
    return df.withColumn("__new", new).withColumn("session", F.expr(f"sum(__new) {over}")).drop("__new")


def islands(df: DataFrame, by: str, order: str, family: str) -> DataFrame:
    """Runs of one family: ``by, island, family, n, first, last``."""
    over = f"over (partition by {by} order by {order})"
    out = df.withColumn("__new", F.expr(f"case when {family} <=> lag({family}) {over} then 0 else 1 end")).withColumn("island", F.expr(f"sum(__new) {over}"))
    return out.groupBy(by, "island").agg(F.first(family).alias(family), F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))


def sandwich_merge(runs: DataFrame, by: str, family: str, most: int = 2) -> DataFrame:
    """``merged``: the number of the group a run belongs to after short runs between two of one family joined these."""
    over = f"over (partition by {by} order by island)"
    inner = runs.withColumn("__in", F.expr(f"n <= {most} and lag({family}) {over} <=> lead({family}) {over} and lag({family}) {over} is not null"))
    joined = inner.withColumn("__go", F.expr(f"case when island = 1 then 1 when __in or lag(__in) {over} then 0 else 1 end"))
    return joined.withColumn("merged", F.expr(f"sum(__go) {over}")).drop("__in", "__go")


def batch_key(name: Column) -> Column:
    """Words of a file name before the first number of 1 to 3 digits, which may not be the first word; null if under three letters."""
    parts = F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda t: t != "")
    at = F.get(F.filter(F.transform(parts, lambda t, i: F.when((i > 0) & t.rlike("^[0-9]{1,3}$"), i)), lambda i: i.isNotNull()), F.lit(0))
    key = F.array_join(F.slice(parts, F.lit(1), F.coalesce(at, F.size(parts))), " ")
    return F.when(F.length(F.regexp_replace(key, "[^a-z]", "")) >= 3, key)


def base_name(name: Column) -> Column:
    """A page's name without its number."""
    return F.regexp_replace(name, r"[\s_#-]*[0-9]+$", "")


def protected(df: DataFrame, group: str, hit: Column, least: int = 6, share: float = 1 / 3) -> DataFrame:
    """``n, hits, released`` by group: a group of six or more with hits in under a third releases no member."""
    out = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    return out.withColumn("released", F.when((F.col("n") >= least) & (F.col("hits") < F.col("n") * share), F.lit(0).cast("long")).otherwise(F.col("hits")))


def running_total(df: DataFrame, order: Column, value: Column) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over all rows that come earlier in ``order``, which must be unique.

    Rows are dealt by range and written, so their parts stay the same; each part sums its own, and the parts' totals, one
    row for each, are added up. No task sees all rows.
    """
    parts = stored(df.withColumn("__v", value).repartitionByRange(order).withColumn("__p", F.spark_partition_id()), "ranges")
    inside = parts.withColumn("__in", F.sum("__v").over(Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
    totals = parts.groupBy("__p").agg(F.sum("__v").alias("__n"))
    ahead = totals.withColumn("__o", F.expr("sum(__n) over (order by __p rows between unbounded preceding and 1 preceding)")).drop("__n")
    out = inside.join(F.broadcast(ahead), "__p")  # as many rows as there are partitions
    return out.withColumn("before", (F.coalesce("__in", F.lit(0)) + F.coalesce("__o", F.lit(0))).cast("long")).drop("__p", "__v", "__in", "__o")


def systematic(df: DataFrame, key: str, every: int) -> DataFrame:
    """Every k-th row by a unique key, with its ``rank``."""
    return running_total(df, F.col(key).asc(), F.lit(1)).withColumn("rank", F.col("before") + 1).where(F.col("rank") % every == 0).drop("before")


def unique_labels(df: DataFrame, label: str, order: str) -> DataFrame:
    """Labels made unique: the second is 'x (2)'."""
    n = F.expr(f"row_number() over (partition by {label} order by {order})")
    return df.withColumn("__n", n).withColumn("unique_label", F.when(F.col("__n") == 1, F.col(label)).otherwise(F.format_string("%s (%d)", F.col(label), F.col("__n")))).drop("__n")


def folder_signature(df: DataFrame, folder: str, name: str, size: str) -> DataFrame:
    """16 hex digits over a folder's sorted name:size lines."""
    line = F.concat_ws(":", F.col(name).cast("string"), F.col(size).cast("string"))
    return df.groupBy(folder).agg(F.substring(F.sha1(F.array_join(F.sort_array(F.collect_list(line)), "\n").cast("binary")), 1, 16).alias("signature"))
