"""Text normalisation, sort keys and excerpts as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accented() -> tuple[str, str]:
    """Precomposed letters of the Latin blocks and their base letters, by canonical decomposition."""
    out = {}
    for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(i))
        if len(base) > 1 and all(unicodedata.combining(c) for c in base[1:]):
            out[chr(i)] = base[0]
    return "".join(out), "".join(out.values())


ACCENTED, PLAIN = _accented()
#: Initial articles by language that catalogue order ignores.
ARTICLES = ["the", "an", "a", "le", "la", "les", "l'", "un", "une", "der", "die", "das", "el", "los", "las", "o", "os", "il", "lo", "gli"]


def fold(c: Column) -> Column:
    """Accents off, ligatures kept; stays in generated code."""
    return F.translate(F.regexp_replace(c, r"\p{Mn}", ""), ACCENTED, PLAIN)


def normalise(c: Column) -> Column:
    """Folded, lower case, every other run than a-z0-9 one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]+", " "))


def expand_ligatures(c: Column) -> Column:
    """For readers' searches: long s, ae, oe and sharp s written out before folding."""
    for a, b in (("ſ", "s"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("ß", "ss")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def reader_normalise(c: Column) -> Column:
    return normalise(expand_ligatures(c))


def latin(c: Column) -> Column:
    """Latin spelling: v as u, j as i."""
    return F.translate(normalise(c), "vj", "ui")


def compact_title(c: Column) -> Column:
    """Normalised without blanks, first 80 characters: the reference form for title equality."""
    return F.substring(F.replace(normalise(c), F.lit(" "), F.lit("")), 1, 80)


def tokens(c: Column) -> Column:
    return F.filter(F.split(normalise(c), " "), lambda t: t != "")


def words(c: Column) -> Column:
    """Distinct normalised words longer than one character."""
    return F.array_distinct(F.filter(F.split(normalise(c), " "), lambda t: F.length(t) > 1))


def title_key(c: Column) -> Column:
    """Catalogue order: leading punctuation and one initial article off, folded, digits padded to 8; null when blank."""
    plain = F.regexp_replace(F.lower(fold(F.regexp_replace(c, r"^[\s\"'(\[«„“]+", ""))), "^(" + "|".join(ARTICLES) + r")(\s+|(?<='))", "")
    return padded(plain)


def padded(c: Column) -> Column:
    """A portable sort key: words of a-z0-9, numbers padded to 8 digits."""
    parts = F.filter(F.split(F.trim(F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]+", " ")), " "), lambda t: t != "")
    key = F.array_join(F.transform(parts, lambda t: F.when(t.rlike("^[0-9]{1,8}$"), F.lpad(t, 8, "0")).otherwise(t)), " ")
    return F.when(key != "", key)


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*[F.when(~is_blank(c), c) for c in cols])


def safe_segment(c: Column) -> Column:
    """A file-name part: forbidden characters to '-', blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "-"), r"\s+", " "))


def excerpt(toks: Column, at: Column, before: int = 4, size: int = 14) -> Column:
    """``size`` tokens around position ``at`` (from 0)."""
    return F.array_join(F.slice(toks, F.greatest(F.lit(1), at - before + 1).cast("int"), F.lit(size)), " ")


def filled(template: Column, values: Column) -> Column:
    """``{name}`` placeholders replaced from a map."""
    return F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def drop_empty(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull() & (v != ""))


def useful_text(c: Column, pages: Column) -> Column:
    """Whether a text layer has more than 100 letters for each of the first three pages."""
    return F.length(F.regexp_replace(c, r"\P{L}", "")) > 100 * F.least(pages, F.lit(3))


def safe_path(c: Column) -> Column:
    """A relative path without '..' or empty parts."""
    return ~c.startswith("/") & ~F.exists(F.split(c, "/"), lambda p: (p == "") | (p == "..") | (p == "."))
