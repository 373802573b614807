"""What pages and their texts tell: covers, cover sheets, imprint pages, page marks, notation file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import rules, text
from folioscope.functions.dates import year

PARTS = ["violin", "viola", "cello", "bass", "flute", "oboe", "clarinet", "bassoon", "horn", "trumpet", "trombone", "soprano", "alto", "tenor", "organ", "piano", "harpsichord", "lute", "guitar", "score"]
MONTHS = r"(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"


def lines_of(words: Column, tolerance: float = 0.5) -> Column:
    """Words array<struct(text, x, y, height)> as lines array<struct(text, y, height)>: words within ``tolerance`` of a height of each other, from left to right."""
    ordered = F.array_sort(F.transform(words, lambda w: F.struct(w["y"].alias("y"), w["x"].alias("x"), w["text"].alias("text"), w["height"].alias("height"))))
    empty = F.array().cast("array<struct<y:double,items:array<struct<x:double,text:string,height:double>>>>")

    def add(lines: Column, w: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        item = F.struct(w["x"].cast("double").alias("x"), w["text"].alias("text"), w["height"].cast("double").alias("height"))
        joins = F.coalesce(F.abs(last["y"] - w["y"]) <= tolerance * w["height"], F.lit(False))
        longer = F.concat(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.struct(last["y"].alias("y"), F.concat(last["items"], F.array(item)).alias("items"))))
        return F.when(joins, longer).otherwise(F.concat(lines, F.array(F.struct(w["y"].cast("double").alias("y"), F.array(item).alias("items")))))

    return F.transform(F.aggregate(ordered, empty, add), lambda g: F.struct(F.array_join(F.transform(F.array_sort(g["items"]), lambda i: i["text"]), " ").alias("text"), g["y"].alias("y"), F.array_max(F.transform(g["items"], lambda i: i["height"])).alias("height")))


def cover(blocks: Column) -> Column:
    """struct(title, author, year) of blocks array<struct(text, y, height)>: the largest type is the title, the nearest name the author."""
    sized = F.filter(blocks, lambda b: F.length(F.regexp_replace(b["text"], r"\P{L}", "")) >= 3)
    best = F.array_max(F.transform(sized, lambda b: F.struct(b["height"].alias("h"), (-b["y"]).alias("y"), b["text"].alias("t"))))
    names = F.filter(sized, lambda b: rules.person_like(b["text"]) & (b["text"] != best["t"]))
    near = F.array_min(F.transform(names, lambda b: F.struct(F.abs(b["y"] + best["y"]).alias("d"), b["text"].alias("t"))))
    whole = F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")
    return F.struct(best["t"].alias("title"), near["t"].alias("author"), F.nullif(year(whole), F.lit(0)).alias("year"))


def article_sheet(c: Column) -> Column:
    """struct(title, authors, journal, volume, issue, year, pages, review, stable_id) of an article's cover sheet with labelled lines."""
    m = lambda p, n=1: F.nullif(F.trim(F.regexp_extract(c, p, n)), F.lit(""))
    source = r"(?m)^Source:\s*(.+?),\s*(?:Vol\.?\s*([0-9A-Za-z]+))?(?:,?\s*No\.?\s*([0-9/-]+))?[^(\n]*\(([^)]*)\)(?:,\s*pp?\.\s*([0-9]+\s*[-–]\s*[0-9]+|[0-9]+))?"
    first = m(r"(?m)\A\s*(.+)$")
    return F.struct(
        F.when(first.rlike(r"(?i)^review"), m(r"(?m)^Reviewed Work\(s\):\s*(.+)$")).otherwise(first).alias("title"),
        F.filter(F.split(F.coalesce(m(r"(?m)^(?:Author\(s\)|Review by|By):\s*(.+)$"), F.lit("")), r"\s*(?:,| and |;)\s*"), lambda a: a != "").alias("authors"),
        m(source).alias("journal"), m(source, 2).alias("volume"), m(source, 3).alias("issue"), F.nullif(year(F.coalesce(m(source, 4), F.lit(""))), F.lit(0)).alias("year"), m(source, 5).alias("pages"),
        F.coalesce(first.rlike("(?i)^review") | c.rlike(r"(?m)^Review(ed Work| by)"), F.lit(False)).alias("review"), m(r"(?m)^Stable URL:\s*(\S+)").alias("stable_id"),
    )


def imprint_page(c: Column) -> Column:
    """map(label, value) of a book's imprint page: 'Label: value' lines, and a label alone with its value on the next line."""
    colon = F.regexp_extract_all(c, F.lit(r"(?m)^\s*(\p{L}[\p{L} ]{2,30}):[ \t]*\S.*$"), F.lit(1))
    values = F.regexp_extract_all(c, F.lit(r"(?m)^\s*\p{L}[\p{L} ]{2,30}:[ \t]*(\S.*)$"), F.lit(1))
    below = F.regexp_extract_all(c, F.lit(r"(?m)^\s*(\p{L}[\p{L} ]{2,30}):?[ \t]*\n[ \t]{2,}\S.*$"), F.lit(1))
    below_values = F.regexp_extract_all(c, F.lit(r"(?m)^\s*\p{L}[\p{L} ]{2,30}:?[ \t]*\n[ \t]{2,}(\S.*)$"), F.lit(1))
    pairs = F.arrays_zip(F.transform(F.concat(colon, below), F.lower).alias("k"), F.transform(F.concat(values, below_values), lambda x: F.trim(x)).alias("v"))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return F.map_from_entries(first)


def page_of(c: Column, position: Column) -> Column:
    """The page a position (from 1) of a text is on: the last '[p. n]' mark before it."""
    marks = F.regexp_extract_all(F.substring(c, F.lit(1), position), F.lit(r"\[p\. ([0-9]+)\]"), F.lit(1))
    return F.try_element_at(marks, F.lit(-1)).cast("int")


def notation_name(name: Column) -> Column:
    """struct(title, part, version, number, key, catalogue) of a notation file's name."""
    base = F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", "")
    low = text.tokens(base)
    part = F.get(F.filter(low, lambda w: w.isin(*PARTS)), F.lit(0))
    version = F.regexp_extract(base, r"(?i)\bv(?:er(?:sion)?)?\.?\s*([0-9]{1,2})\b", 1)
    number = F.regexp_extract(base, r"(?i)\b(?:no?\.?|nr\.?)\s*([0-9]{1,3})\b", 1)
    title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"(?i)[-_ ]+v(er(sion)?)?\.?\s*[0-9]{1,2}\b", ""), r"(?i)[-_ ]+(" + "|".join(PARTS) + r")(\s+[0-9IV]+)?\s*$", ""), "_", " "), r"\s+", " "))
    return F.struct(title.alias("title"), part.alias("part"), F.nullif(version, F.lit("")).cast("int").alias("version"), F.nullif(number, F.lit("")).cast("int").alias("number"), rules.key_of_title(base).alias("key"), rules.catalogue_number(base).alias("catalogue"))


def source_clues(name: Column) -> Column:
    """struct(siglum, shelfmark, folios, year) that the name of an early source's file gives."""
    base = F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", ""), "_", " ")
    m = lambda p, n=1: F.nullif(F.trim(F.regexp_extract(base, p, n)), F.lit(""))
    sig = r"\b([A-Z]{1,3}-[A-Z][A-Za-z]{0,5})\s+((?:[A-Za-z.]+\s*){0,4}[0-9]+[0-9a-z./-]*)?"
    return F.struct(m(sig).alias("siglum"), m(sig, 2).alias("shelfmark"), m(r"\b(?:f{1,2}|fol)\.?\s*([0-9]+[rv]?(?:\s*-\s*[0-9]+[rv]?)?)").alias("folios"), F.nullif(year(base), F.lit(0)).alias("year"))


def best_name(names: Column) -> Column:
    """The file name that tells most; the first of equals."""
    return F.array_max(F.transform(names, lambda n, i: F.struct(rules.name_information(n).alias("s"), (-i).alias("o"), n.alias("n"))))["n"]


def work_compatible(title: Column, work: Column, movements: Column | None = None, work_key: Column | None = None) -> Column:
    """Whether an identified work can be what a title names.

    In this order: numbers of one catalogue must agree, then places in a series; a numbered piece is no collection; a
    collection is no single work of a known kind; a single piece is no run of a catalogue's numbers; announced counts and
    keys (where both name a mode) must agree; a dance must be among the work's movements where these are known; else the kinds named must meet (a movement
    may be of the kind). What one side does not say vetoes nothing; nulls say nothing.
    """
    title, work = F.coalesce(title, F.lit("")), F.coalesce(work, F.lit(""))
    movements = F.lit(None).cast("string") if movements is None else movements
    differ = lambda a, b: F.coalesce(a != b, F.lit(False))
    number, number_w = rules.catalogue_number(title), rules.catalogue_number(work)
    family = lambda n: F.regexp_extract(n, "^([A-Za-z]+)", 1)
    place, place_w = rules.serial_number(title), rules.serial_number(work)
    run = rules.catalogued_run(work)
    many, single_w = rules.several_works(title), ~rules.several_works(work) & ~run
    kinds, kinds_w, dance = rules.genres_of(title), rules.genres_of(work), rules.dance_of(title)
    key_w = rules.key_with_mode(work) if work_key is None else F.coalesce(rules.key_with_mode(work), work_key)
    counts = rules.work_count
    veto = (
        (F.coalesce(family(number) == family(number_w), F.lit(False)) & differ(number, number_w))
        | differ(place, place_w)
        | (place.isNotNull() & work.rlike(r"^[0-9]+\s"))
        | (many & single_w & (F.size(kinds_w) > 0))
        | (~many & run)
        | differ(counts(title), counts(work))
        | differ(rules.key_with_mode(title), key_w)
    )
    apart = (F.size(kinds) > 0) & (F.size(kinds_w) > 0) & ~F.arrays_overlap(kinds, F.array_union(kinds_w, rules.genres_of(movements)))
    danced = text.normalise(movements).contains(dance)
    return ~veto & F.when(dance.isNotNull() & movements.isNotNull(), danced).otherwise(~apart)


def work_plausible(title: Column, work: Column, movements: Column | None = None) -> Column:
    """Whether a work that only a number points to is borne out by the title: compatible, and a dance of its movements, a whole movement, or a strong word in common.

    Words are compared by their first five letters; a long word of the title may also hold a strong stem of the work ('Triosonate').
    """
    title = F.coalesce(title, F.lit(""))
    parts = F.coalesce(movements if movements is not None else F.lit(None).cast("string"), F.lit(""))
    dance, plain = rules.dance_of(title), text.normalise(title)
    danced = F.coalesce(text.normalise(parts).contains(dance), F.lit(False))
    whole = (F.size(text.tokens(title)) >= 2) & F.exists(F.split(parts, "\n"), lambda m: (text.normalise(m) == plain) | text.normalise(m).startswith(F.concat(plain, F.lit(" "))))
    own, theirs = rules.strong_stems(title), rules.strong_stems(F.concat_ws(" ", work, parts))
    long = F.filter(text.tokens(title), lambda w: F.length(w) >= 8)
    held = F.exists(long, lambda w: F.exists(theirs, lambda x: (F.length(x) >= 5) & w.contains(x)))
    return work_compatible(title, work, movements) & (danced | whole | F.arrays_overlap(own, theirs) | held)
