"""Similarity of titles, names and fingerprints as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import text


def round2(c: Column) -> Column:
    """Half up to 2 decimals, equal in every engine."""
    return F.floor(c * 100 + 0.5) / 100.0


def round6(c: Column) -> Column:
    return F.floor(c * 1e6 + 0.5) / 1e6


def dice_of(a: Column, b: Column) -> Column:
    """2|A & B| / (|A| + |B|) of two arrays of distinct words; 0 when either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))).otherwise(0.0)


def dice_from(shared: Column, na: Column, nb: Column) -> Column:
    """:func:`dice_of` from the numbers of words: shared, of each."""
    return F.when((na > 0) & (nb > 0), 2.0 * shared / (na + nb)).otherwise(0.0)


def dice(a: Column, b: Column) -> Column:
    return dice_of(text.words(a), text.words(b))


def containment_of(a: Column, b: Column) -> Column:
    """Share of A's words in B; 0 when A has under three words or B none."""
    return F.when((F.size(a) >= 3) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) * 1.0 / F.size(a)).otherwise(0.0)


def containment_from(shared: Column, na: Column, nb: Column) -> Column:
    """:func:`containment_of` from the numbers of words: shared, of A, of B."""
    return F.when((na >= 3) & (nb > 0), shared * 1.0 / na).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    return containment_of(text.words(a), text.words(b))


def latin_similarity(a: Column, b: Column) -> Column:
    x, y = text.words(text.latin(a)), text.words(text.latin(b))
    return F.greatest(dice_of(x, y), containment_of(x, y), 0.9 * containment_of(y, x))


PART = "([0-9]{1,3}|[ivxlc]+)$"


def title_equal(a: Column, b: Column) -> Column:
    """Equal compact titles, or the shorter (30 characters and more) begins the longer and no part number tells them apart."""
    x, y = text.compact_title(a), text.compact_title(b)
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    rest = F.substr(long, F.length(short) + 1)
    ends = [F.regexp_extract(text.normalise(c), r"(?:^| )" + PART, 1) for c in (a, b)]
    parts_ok = (ends[0] == "") | (ends[1] == "") | (ends[0] == ends[1])
    return (x == y) | ((F.length(short) >= 30) & long.startswith(short) & ~rest.rlike("^" + PART) & parts_ok)


def years_ok(a: Column, b: Column) -> Column:
    """First four-digit runs equal, or one unknown."""
    x, y = (F.regexp_extract(F.coalesce(c, F.lit("")), "([0-9]{4})", 1) for c in (a, b))
    return (x == "") | (y == "") | (x == y)


def surname_like(a: Column, b: Column) -> Column:
    """Edit distance within a quarter of the length (1 at least), or two with the same three first letters from five on."""
    d = F.levenshtein(a, b)
    longest = F.greatest(F.length(a), F.length(b))
    return (d <= F.greatest(F.lit(1), F.floor(longest / 4))) | ((F.substring(a, 1, 3) == F.substring(b, 1, 3)) & (F.least(F.length(a), F.length(b)) >= 5) & (d <= 2))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of longs; null when lengths differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x))
