"""Bulk edits, protected merges and propagation, as before/after columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import first_filled, is_blank

MODES = ("only-if-empty", "replace", "add", "remove")


def validated(changes: dict[str, tuple[str, object]], allowed: list[str], most_ids: int | None = None, n_ids: int = 0) -> None:
    """Raises for unknown fields or modes, empty values, and too many records."""
    for field, (mode, value) in changes.items():
        if field not in allowed:
            raise ValueError(f"field cannot be edited: {field}")
        if mode not in MODES:
            raise ValueError(f"unknown mode: {mode}")
        if value in (None, "", []):
            raise ValueError(f"empty value for {field}")
    if most_ids is not None and n_ids > most_ids:
        raise ValueError(f"at most {most_ids} records at once")


def edited(old: Column, mode: str, value: Column) -> Column:
    if mode == "only-if-empty":
        return F.when(is_blank(old), value).otherwise(old)
    if mode == "replace":
        return value
    if mode == "add":
        return F.array_union(F.coalesce(old, F.array().cast("array<string>")), F.array(value))
    return F.array_remove(old, value)


def bulk_edit(df: DataFrame, changes: dict[str, tuple[str, object]], where: Column) -> DataFrame:
    """``df`` with ``new_<field>`` for each change and ``changed``; rows outside ``where`` keep their values."""
    out, differ = df, F.lit(False)
    for field, (mode, value) in changes.items():
        new = F.when(where, edited(F.col(field), mode, value if isinstance(value, Column) else F.lit(value))).otherwise(F.col(field))
        out = out.withColumn(f"new_{field}", new)
        differ = differ | ~F.col(field).eqNullSafe(F.col(f"new_{field}"))
    return out.withColumn("changed", differ)


def protect(old: Column, new: Column, strong: Column, keep_precise: bool = False) -> Column:
    """A field on re-analysis: an empty old value gives way; a strong one stays; a more precise date stays; a new empty value restores the old."""
    stays = strong | is_blank(new)
    if keep_precise:
        stays = stays | (old.startswith(new) & (F.length(old) > F.length(new)))
    return F.when(is_blank(old), new).when(stays, old).otherwise(new)


def fill_empty(old: Column, new: Column) -> Column:
    return first_filled(old, new)


def propagate(children: DataFrame, changes: DataFrame, key: str, field: str) -> DataFrame:
    """Children take a parent's change(before, after) only where they still hold the value before."""
    c = changes.select(key, F.col("before").alias("__b"), F.col("after").alias("__a")).where(~F.col("before").eqNullSafe(F.col("after")))
    out = children.join(c, key, "left")
    takes = F.col("__a").isNotNull() & F.col(field).eqNullSafe(F.col("__b"))
    return out.withColumn("taken", F.coalesce(takes, F.lit(False))).withColumn(field, F.when(F.col("taken"), F.col("__a")).otherwise(F.col(field))).drop("__a", "__b")


def upsert(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Plain parquet has no MERGE: rows not replaced, and the new ones."""
    return current.join(new.select(key), key, "left_anti").unionByName(new.select(current.columns))
