"""Rules that weigh evidence about records: titles, codes, editions, states, corrections, early datings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import rules, text
from folioscope.functions.similarity import title_equal

MEDIA = ["lp", "cd", "sacd", "dvd", "blu-ray", "cassette", "78 rpm"]
TOOLS = r"(?i)(microsoft word|untitled|\.(docx?|indd|tex|qxd|pdf)$|^document ?\d*$|scan(ned)?( by)?|acrobat|ghostscript)"
LIBRARIES = [("ark", r"ark:/[0-9]{5}/[A-Za-z0-9._-]+"), ("bsb", r"\bbsb[0-9]{8}\b"), ("purl", r"https?://purl\.[a-z.]+/[^\s]+"), ("urn", r"urn:nbn:[a-z]{2}:[^\s]+")]


def titles_compatible(a: Column, b: Column) -> Column:
    """Half of the shorter title's words shared; true if either has none."""
    x, y = text.words(a), text.words(b)
    least = F.least(F.size(x), F.size(y))
    return (least == 0) | (F.size(F.array_intersect(x, y)) * 2 >= least)


def core_title(c: Column) -> Column:
    """Without parentheses and catalogue numbers, normalised."""
    plain = F.regexp_replace(c, r"\([^)]*\)", " ")
    for mark in rules.CATALOGUES:
        plain = F.regexp_replace(plain, rules.mention(mark), " ")
    return text.normalise(plain)


def code_confirmed(same_number: Column, performer: Column, title: Column, seen: Column) -> Column:
    """An uncertain code counts if the catalogue number agrees, a performer's word stands in the text seen, or two title words do."""
    w = text.words(seen)
    return same_number | (F.size(F.array_intersect(text.words(performer), w)) >= 1) | (F.size(F.array_intersect(text.words(title), w)) >= 2)


def label_number(c: Column) -> Column:
    """A label's catalogue number: two to five capitals and digits in groups."""
    return F.nullif(F.regexp_extract(c, r"\b([A-Z]{2,5}[ -]?[0-9]{2,6}(?:[ -][0-9]{1,3})?)\b", 1), F.lit(""))


def rights_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?:©|℗|\([CP]\)|(?i:copyright))\s*([12][0-9]{3})", 1), F.lit("")).cast("int")


def medium(c: Column) -> Column:
    return F.get(F.filter(F.array(*map(F.lit, MEDIA)), lambda m: F.concat(F.lit(" "), F.lower(c), F.lit(" ")).contains(F.concat(F.lit(" "), m, F.lit(" ")))), F.lit(0))


def library_ids(c: Column) -> Column:
    """array<struct(kind, id)> of identifiers of digital libraries."""
    parts = []
    for kind, pattern in LIBRARIES:
        parts.append(F.transform(F.array_distinct(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))), _tagged(kind)))
    return F.concat(*parts)


def _tagged(kind: str):
    return lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("id"))


def dating(c: Column) -> Column:
    """Catalogue datings in German or English as 'YYYY-YYYY': quarters, halves, thirds, beginning, middle or end of a century; a year with a mark as 'c.', 'after' or 'before' it; else null."""
    century = F.regexp_extract(c, r"([0-9]{1,2})(?:\.|st|nd|rd|th)\s*(?:Jh\.?|Jahrhundert|cent\.?|century)", 1)
    base = (F.nullif(century, F.lit("")).cast("int") - 1) * 100
    part = F.regexp_extract(c, r"(?i)([1-4])\.?(?:st|nd|rd|th)?\s*(?:viertel|quarter)", 1)
    half = F.regexp_extract(c, r"(?i)([12])\.?(?:st|nd)?\s*(?:hälfte|half)", 1)
    third = F.regexp_extract(c, r"(?i)([1-3])\.?(?:st|nd|rd)?\s*(?:drittel|third)", 1)
    q, h, t = (F.nullif(x, F.lit("")).cast("int") for x in (part, half, third))
    lo = F.when(q.isNotNull(), (q - 1) * 25 + 1).when(h.isNotNull(), (h - 1) * 50 + 1).when(t.isNotNull(), (t - 1) * 33 + 1).when(c.rlike("(?i)anfang|beginning|early"), 1).when(c.rlike("(?i)mitte|middle|mid-"), 34).when(c.rlike("(?i)ende|end of|late"), 67).otherwise(1)
    hi = F.when(q.isNotNull(), q * 25).when(h.isNotNull(), h * 50).when(t == 3, 100).when(t.isNotNull(), t * 33).when(c.rlike("(?i)anfang|beginning|early"), 33).when(c.rlike("(?i)mitte|middle|mid-"), 66).otherwise(100)
    marked = [(mark, F.regexp_extract(c, rf"(?i)\b(?:{words})\s*([0-9]{{4}})\b", 1)) for mark, words in (("c.", r"um|ca\.?|c\.|circa|around"), ("after", "nach|after"), ("before", "vor|before"))]
    years = F.coalesce(*[F.when(y != "", F.concat_ws(" ", F.lit(mark), y)) for mark, y in marked])
    return F.when(base.isNotNull(), F.concat_ws("-", (base + lo).cast("string"), (base + hi).cast("string"))).otherwise(years)


def musical_text(c: Column) -> Column:
    """Whether a text layer is glyphs of a music font: 25 and more tokens, or over 15 %, without a letter run of two."""
    tokens = F.filter(F.split(c, r"\s+"), lambda t: t != "")
    odd = F.size(F.filter(tokens, lambda t: ~t.rlike(r"[\p{L}]{2}") & ~t.rlike(r"^[0-9.,:;()-]+$") & ~t.rlike(r"^\p{L}$")))
    return (odd >= 25) | (odd > 0.15 * F.size(tokens))


def useful_title(c: Column) -> Column:
    """A document property that is a title, not a tool's name or a placeholder."""
    return F.coalesce(~c.rlike(TOOLS) & (F.length(F.regexp_replace(c, r"\P{L}", "")) >= 4), F.lit(False))


def plausible_title(c: Column) -> Column:
    """No lyric syllables ('glo - ri - a'), no bare shelfmark, and two letters in a row."""
    return c.rlike(r"\p{L}{2}") & ~c.rlike(r"(\p{L}{1,4} - ){2,}") & ~c.rlike(r"^[A-Z]{1,3}-[A-Z][A-Za-z]{1,5}\b.{0,20}$")


def academic_authors(authors: Column, title: Column) -> Column:
    """Authors of studies: a composer whose surname the title names is its subject, unless nobody else is left."""
    padded = lambda c: F.concat(F.lit(" "), text.normalise(c), F.lit(" "))  # noqa: E731  a surname may have several words
    named = lambda a: F.coalesce(padded(title).contains(padded(a["surname"])) & (a["role"] == "composer"), F.lit(False))
    rest = F.filter(authors, lambda a: ~named(a))
    return F.when(F.size(rest) > 0, rest).otherwise(authors)


def state(title: Column, authors: Column, date: Column, modern: Column, contradiction: Column, was_complete_and_whole: Column) -> Column:
    """'complete' with title, authors and date (the date may lack for a modern edition); a contradiction always goes to review."""
    whole = ~text.is_blank(title) & (F.size(F.coalesce(authors, F.array())) > 0) & (~text.is_blank(date) | modern)
    return F.when(contradiction, "review").when(whole | was_complete_and_whole, "complete").otherwise("review")


def edition_confirmed(year_a: Column, year_b: Column, number_a: Column, number_b: Column, code_a: Column, code_b: Column) -> Column:
    """'confirmed' with one piece of evidence and none against, 'denied' with any against, else 'open'. Years may differ by one."""
    says = lambda a, b, same: F.when(a.isNotNull() & b.isNotNull(), F.when(same, 1).otherwise(-1)).otherwise(0)
    votes = F.array(says(year_a, year_b, F.abs(year_a - year_b) <= 1), says(number_a, number_b, text.compact_title(number_a) == text.compact_title(number_b)), says(code_a, code_b, F.ltrim(F.translate(code_a, " ", "")) == F.ltrim(F.translate(code_b, " ", ""))))
    against, for_ = F.exists(votes, lambda v: v < 0), F.exists(votes, lambda v: v > 0)
    return F.when(against, "denied").when(for_, "confirmed").otherwise("open")


def corrections(title: Column, publisher: Column, place: Column) -> Column:
    """map(field, new value) of what should change: a title's closing mark, placeholder imprints."""
    none = r"(?i)^\W*(s\.?\s*[ln]\.?|sine (loco|nomine))\W*$"
    fixed = F.regexp_replace(F.trim(title), r"\s*[/:;,=]\s*$", "")
    found = F.array(
        F.when(fixed != title, F.struct(F.lit("title").alias("k"), fixed.alias("v"))),
        F.when(publisher.rlike(none), F.struct(F.lit("publisher").alias("k"), F.lit("").alias("v"))),
        F.when(place.rlike(none), F.struct(F.lit("place").alias("k"), F.lit("").alias("v"))),
    )
    return F.map_from_entries(F.array_compact(found))


def joined_lines(lines: Column) -> Column:
    """Lines that do not end a sentence or entry run on into the next: one string for each entry."""
    fold = F.aggregate(lines, F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open")), lambda a, x: _taken(a, F.trim(x)))
    return F.when(fold["open"] != "", F.concat(fold["done"], F.array(fold["open"]))).otherwise(fold["done"])


def _taken(a: Column, line: Column) -> Column:
    whole = F.trim(F.concat_ws(" ", a["open"], line))
    ends = line.rlike("[.;]$") | (line == "")
    return F.when(ends, F.struct(F.when(whole != "", F.concat(a["done"], F.array(whole))).otherwise(a["done"]).alias("done"), F.lit("").alias("open"))).otherwise(F.struct(a["done"].alias("done"), whole.alias("open")))


def verified(title_model: Column, title_found: Column, surname_model: Column, surname_found: Column) -> Column:
    """What a catalogue says about a record that only a model read: confirmed, diverges, no composer, not found."""
    return F.when(title_found.isNull(), "not found").when(surname_found.isNull(), "no composer").when(title_equal(title_model, title_found) & (text.normalise(surname_model) == text.normalise(surname_found)), "confirmed").otherwise("diverges")
