"""Person names: parsing, principal author, display, citation keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import text

# Particles of surnames.
PARTICLES = ["da", "das", "de", "del", "della", "des", "di", "do", "dos", "du", "la", "le", "van", "von", "der", "den", "zu"]
INSTITUTION = r"(?i)\b(university|universidade|library|biblioteca|museum|museu|institute|instituto|archive|arquivo|academy|society|foundation|ministry)\b"


def person(c: Column) -> Column:
    """struct(surname, given, literal): 'surname, given'; an institution as it is; else the last word with its particles, never the first word."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    parts = F.split(t, " ")
    n = F.size(parts)
    particles = F.array(*map(F.lit, PARTICLES))
    # how many words before the last one are particles without a gap
    run = F.aggregate(
        F.reverse(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0)))),
        F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")),
        lambda s, w: F.struct((s["k"] + F.when(s["on"] & F.array_contains(particles, F.lower(w)), 1).otherwise(0)).alias("k"), (s["on"] & F.array_contains(particles, F.lower(w))).alias("on")),
    )["k"]
    start = n - run
    comma = F.instr(t, ",") > 0
    surname = F.when(comma, F.trim(F.split_part(t, F.lit(","), F.lit(1)))).when(t.rlike(INSTITUTION), None).when(n == 1, t).otherwise(F.array_join(F.slice(parts, start, run + 1), " "))
    given = F.when(comma, F.trim(F.split_part(t, F.lit(","), F.lit(2)))).when(t.rlike(INSTITUTION) | (n == 1), None).otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(start - 1, F.lit(0))), " "))
    return F.struct(surname.alias("surname"), given.alias("given"), F.when(~comma & t.rlike(INSTITUTION), t).alias("literal"))


def principal(authors: Column) -> Column:
    """The first author with a principal role (none counts as author), else the first, as literal, surname or given name."""
    roles = F.array(*map(F.lit, ["author", "composer", "editor", "performer"]))
    main = F.filter(authors, lambda a: F.array_contains(roles, F.coalesce(a["role"], F.lit("author"))))
    first = F.get(F.concat(main, authors), F.lit(0))
    return text.first_filled(first["literal"], first["surname"], first["given"])


def display(authors: Column, most: int = 3) -> Column:
    one = lambda a: text.first_filled(a["literal"], F.concat_ws(", ", a["surname"], a["given"]))
    listed = F.array_join(F.transform(F.slice(authors, 1, most), one), "; ")
    return F.when(F.size(authors) > most, F.concat(listed, F.lit(" et al."))).otherwise(listed)


def citation_key(surname: Column, year: Column, title: Column) -> Column:
    """Letters of the surname, the year, and the first title word longer than three letters, lower case."""
    long_word = F.get(F.filter(F.split(text.normalise(title), " "), lambda w: F.length(w) > 3), F.lit(0))
    return F.concat(F.regexp_replace(F.lower(text.fold(surname)), "[^a-z]", ""), year.cast("string"), F.coalesce(long_word, F.lit("")))


def split_artists(c: Column) -> Column:
    """Names apart at , ; & + / and 'feat'."""
    return F.filter(F.transform(F.split(c, r"(?i)\s*(?:[,;&+/]|\bfeat\.?\s)\s*"), lambda x: F.trim(x)), lambda x: x != "")
