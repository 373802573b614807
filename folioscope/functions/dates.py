"""Free-text dates, centuries and numerals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year(c: Column) -> Column:
    """The first run of four digits anywhere, else 0."""
    return F.coalesce(F.expr("null").cast("int"), F.when(F.regexp_extract(c, "([0-9]{4})", 1) != "", F.regexp_extract(c, "([0-9]{4})", 1).cast("int")), F.lit(0))


def date_key(c: Column) -> Column:
    """yyyymmdd of the first YYYY[-MM[-DD]], unknown parts 0; null without a year."""
    part = lambda n: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(c, "([0-9]{4})(?:-([0-9]{2}))?(?:-([0-9]{2}))?", n), F.lit("")), F.lit("9999")).cast("int"), F.lit(0))
    return F.when(c.rlike("[0-9]{4}"), part(1) * 10000 + part(2) * 100 + part(3))


def csl_date(c: Column) -> Column:
    """struct(y, m, d, circa, literal): ISO parts, else the first year with a circa mark, else the text itself."""
    iso = c.rlike(r"^[0-9]{4}(-[0-9]{2}){0,2}$")
    num = lambda n: F.when(iso & (F.regexp_extract(c, r"^([0-9]{4})(?:-([0-9]{2}))?(?:-([0-9]{2}))?$", n) != ""), F.regexp_extract(c, r"^([0-9]{4})(?:-([0-9]{2}))?(?:-([0-9]{2}))?$", n).cast("int"))
    some = F.regexp_extract(c, "([0-9]{4})", 1)
    y = F.when(iso, num(1)).when(some != "", some.cast("int"))
    return F.struct(y.alias("y"), num(2).alias("m"), num(3).alias("d"), (~iso & (some != "")).alias("circa"), F.when(~iso & (some == ""), c).alias("literal"))


def roman(c: Column) -> Column:
    """Value of a Roman numeral (upper case)."""
    value = lambda ch: F.when(ch == "I", 1).when(ch == "V", 5).when(ch == "X", 10).when(ch == "L", 50).when(ch == "C", 100).when(ch == "D", 500).when(ch == "M", 1000).otherwise(0)
    v = F.transform(F.split(c, ""), value)
    signed = F.transform(v, lambda x, i: F.when(x < F.coalesce(F.get(v, i + 1), F.lit(0)), -x).otherwise(x))
    return F.when(c.rlike("^[IVXLCDM]+$"), F.aggregate(signed, F.lit(0), lambda s, x: s + x))


def century(y: Column) -> Column:
    return F.when(y > 0, F.floor((y - 1) / 100).cast("int") + 1)


def duration(seconds: Column) -> Column:
    """h:mm:ss or m:ss."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def more_precise(old: Column, new: Column) -> Column:
    return old.startswith(new) & (F.length(old) > F.length(new))
