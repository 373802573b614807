"""DOI, ISBN, EAN and other identifiers: extraction, checksums, conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOI = r"10\.[0-9]{4,9}/[^\s\"<>]+"
URL = r"https?://[^\s\"'<>]+"


def dois(c: Column) -> Column:
    """All DOIs, trailing punctuation removed."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(f"({DOI})"), F.lit(1)), lambda d: F.lower(F.regexp_replace(d, r"[.,;:)\]}]+$", ""))))


def urls(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"({URL})"), F.lit(1)))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _weighted(c: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + F.substring(c, i + 1, 1).cast("int") * w
    return total


def ean_check_digit(twelve: Column) -> Column:
    """The 13th digit of 12 others."""
    return ((10 - _weighted(twelve, [1, 3] * 6) % 10) % 10).cast("string")


def ean_valid(c: Column) -> Column:
    """EAN-13, or UPC of 12 digits with a leading 0."""
    full = F.lpad(c, 13, "0")
    return F.when(c.rlike("^[0-9]{12,13}$"), ean_check_digit(F.substring(full, 1, 12)) == F.substring(full, 13, 1)).otherwise(False)


def isbn10_check_digit(nine: Column) -> Column:
    d = (11 - _weighted(nine, list(range(10, 1, -1))) % 11) % 11
    return F.when(d == 10, "X").otherwise(d.cast("string"))


def isbn_valid(c: Column) -> Column:
    ten = F.when(c.rlike("^[0-9]{9}[0-9X]$"), isbn10_check_digit(F.substring(c, 1, 9)) == F.substring(c, 10, 1)).otherwise(False)
    return ten | (c.rlike("^97[89][0-9]{10}$") & ean_valid(c))


def isbn13(c: Column) -> Column:
    """ISBN-10 or -13 to ISBN-13; null when not valid."""
    body = F.concat(F.lit("978"), F.substring(c, 1, 9))
    return F.when(isbn_valid(c), F.when(F.length(c) == 10, F.concat(body, ean_check_digit(body))).otherwise(c))


def isbn10(c: Column) -> Column:
    body = F.substring(c, 4, 9)
    return F.when(isbn_valid(c) & (F.length(c) == 13) & c.startswith("978"), F.concat(body, isbn10_check_digit(body)))


def ean_candidates(twelve: Column) -> Column:
    """Codes of which twelve printed digits are the last: every first digit that gives a right checksum."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(d.cast("string"), twelve)), ean_valid)
