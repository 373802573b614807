"""Facet filters, counts and catalogue order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facet_filter(
    equal: dict[str, object] | None = None,
    member: dict[str, object] | None = None,
    like: dict[str, str] | None = None,
    years: tuple[str, int | None, int | None] | None = None,
    unknown_year: str = "kept above",
) -> Column:
    """AND of the parts given. Year 0 is unknown: it passes an upper bound alone ('kept above', list screens) or no bound ('dropped', readers)."""
    out = F.lit(True)
    for c, v in (equal or {}).items():
        out = out & (F.col(c) == v)
    for c, v in (member or {}).items():
        out = out & F.array_contains(c, v)
    for c, v in (like or {}).items():
        out = out & F.lower(c).contains(v.lower())
    if years:
        c, lo, hi = years
        if lo is not None:
            out = out & (F.col(c) >= lo)
        if hi is not None:
            out = out & (F.col(c) <= hi)
        if unknown_year == "dropped" and (lo is not None or hi is not None):
            out = out & (F.col(c) > 0)
    return out


def extension(path: Column) -> Column:
    """Lower-case file extension of a path or URL without its query; 'none' where there is none."""
    name = F.regexp_replace(F.regexp_replace(path, "[?#].*$", ""), "^.*/", "")
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]{1,5})$", 1))
    return F.when(ext == "", "none").otherwise(ext)


def format_filter(path: Column, formats: list[str]) -> Column:
    """OR of the chosen formats; 'none' stands for no file format."""
    return extension(path).isin(*formats)


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def rollup(df: DataFrame, *by: str) -> DataFrame:
    return df.rollup(*by).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
