"""Wiki pages of works: nested templates read by their balance, their fields, and the editions they list."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.dates import year
from folioscope.functions.text import normalise, tokens
from folioscope.operators.ship import ship

#: What a page is cut into: the signs that nest, the sign that divides, and what lies between.
PIECES = r"(\{\{|\}\}|\[\[|\]\]|\||[^{}\[\]|]+|[{}\[\]])"
_PIECE, _FIELD, _FILE = re.compile(r"(\{\{|\}\}|\[\[|\]\]|\|)"), re.compile(r"(?s)([^={}\[\]|]{1,80}?)\s*=\s*(.*)", re.ASCII), re.compile(r"File Name [0-9]+")
#: What is read of a page, as it stands there, and the type that it is read as.
_PAGE = {"title": "Work Title", "alternative": "Alternative Title", "type": "Page Type", "instrumentation": "Instrumentation", "first": "Year of First Publication"}
READ = ", ".join(f"{k} string" for k in _PAGE) + ", blocks array<struct<files: array<string>, editor: string, publisher: array<string>>>"


def _pieces(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(PIECES), F.lit(1))


def templates(c: Column) -> Column:
    """array<string>: the inside of every template, inner ones before the one that holds them; what is not closed is none."""
    none = F.array().cast("array<string>")

    def step(s: Column, p: Column) -> Column:
        n = F.size(s["open"])
        top = F.try_element_at(s["open"], F.lit(-1))
        less = F.slice(s["open"], F.lit(1), F.greatest(n - 1, F.lit(0)))
        whole = F.concat(F.lit("{{"), top, F.lit("}}"))
        closed = F.when(n > 1, F.concat(F.slice(s["open"], F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(F.concat(F.get(s["open"], n - 2), whole)))).otherwise(none)
        plain = F.when(n > 0, F.concat(less, F.array(F.concat(top, p)))).otherwise(none)
        begins, ends = p == "{{", (p == "}}") & (n > 0)
        return F.struct(F.when(begins, F.concat(s["open"], F.array(F.lit("")))).when(ends, closed).otherwise(plain).alias("open"), F.when(ends, F.concat(s["done"], F.array(top))).otherwise(s["done"]).alias("done"))

    return F.aggregate(_pieces(F.coalesce(c, F.lit(""))), F.struct(none.alias("open"), none.alias("done")), step, lambda s: s["done"])


def fields(body: Column) -> Column:
    """array<string>: a template's name and fields, divided where no template or link is open."""
    start = F.struct(F.lit(0).alias("depth"), F.array(F.lit("")).alias("parts"))

    def step(s: Column, p: Column) -> Column:
        depth = s["depth"] + F.when(p.isin("{{", "[["), 1).when(p.isin("}}", "]]"), -1).otherwise(0)
        n = F.size(s["parts"])
        divides = (p == "|") & (s["depth"] <= 0)
        grown = F.concat(F.slice(s["parts"], F.lit(1), n - 1), F.array(F.concat(F.element_at(s["parts"], -1), p)))
        return F.struct(depth.alias("depth"), F.when(divides, F.concat(s["parts"], F.array(F.lit("")))).otherwise(grown).alias("parts"))

    return F.aggregate(_pieces(body), start, step, lambda s: F.transform(s["parts"], lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))))


def named(parts: Column) -> Column:
    """map<string, string> of fields 'name = value'; the last of a name counts."""
    pairs = F.filter(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.struct(F.trim(F.regexp_extract(x, r"(?s)^([^={}\[\]|]{1,80}?)\s*=\s*(.*)$", 1)).alias("k"), F.regexp_extract(x, r"(?s)^([^={}\[\]|]{1,80}?)\s*=\s*(.*)$", 2).alias("v"))), lambda p: p["k"] != "")
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is bound to a variable, so that it is made once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _filled(c: Column) -> Column:
    return _once(c, lambda x: F.nullif(x, F.lit("")))


def unlinked(c: Column) -> Column:
    """Text without links, marks of emphasis and templates."""
    c = F.regexp_replace(F.regexp_replace(c, r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", "$1"), r"\{\{[^{}]*\}\}|'{2,}|<[^<>]*>", "")
    return _filled(F.trim(F.regexp_replace(c, r"\s+", " ")))


def _printer(parts: Column) -> Column:
    """struct<printer, full_name, place, year> of {{P|short|full|place|date|year|...}}."""
    clean = lambda i: _filled(F.regexp_replace(F.coalesce(unlinked(F.get(parts, F.lit(i))), F.lit("")), r"[\s.,;]+$", ""))
    dated = _once(year(F.concat_ws(" ", F.get(parts, F.lit(5)), F.get(parts, F.lit(4)))), lambda y: F.nullif(y, F.lit(0)))
    names = F.struct(clean(1).alias("short"), clean(2).alias("full"))
    return _once(names, lambda n: F.struct(F.coalesce(n["short"], n["full"]).alias("printer"), F.coalesce(n["full"], n["short"]).alias("full_name"), clean(3).alias("place"), dated.alias("year")))


def _fields(body: str) -> list[str]:
    depth, parts = 0, [""]
    for p in _PIECE.split(body):
        depth += (p in ("{{", "[[")) - (p in ("}}", "]]"))
        if p == "|" and depth <= 0:
            parts.append("")
        else:
            parts[-1] += p
    return parts


def _bodies(text: str) -> list[list[str]]:
    """``fields`` of each of ``templates`` of one text in plain Python: a page has hundreds of pieces, and folding them in expressions copies what is read at each."""
    opened, done, stray = [], [], False  # of each open template its parts and how many links are open; whether a link ends that none began
    for p in _PIECE.split(text):
        if p == "{{":
            opened.append([[""], 0])
        elif not opened:
            continue
        elif p == "}}":
            parts, depth = opened.pop()
            done.append(parts)
            if opened:
                opened[-1][0][-1] += "{{" + "|".join(parts) + "}}"
                opened[-1][1] += depth
        elif p == "|" and opened[-1][1] <= 0:
            opened[-1][0].append("")
        else:
            opened[-1][0][-1] += p
            opened[-1][1] += (p == "[[") - (p == "]]")
            stray = stray or opened[-1][1] < 0
    return [[x.strip(" \t\n\x0b\f\r") for x in (_fields("|".join(parts)) if stray else parts)] for parts in done]


def _named(parts: list[str]) -> dict[str, str]:
    out = {}
    for k, v in (m.groups() for m in map(_FIELD.match, parts[1:]) if m):
        if k := k.strip(" "):
            out.pop(k, None)
            out[k] = v
    return out


def _read(text: str | None) -> dict:
    """One page as ``READ`` has it."""
    each = _bodies(text or "")
    page = next((m for m in (_named(t) for t in each if t[0].lower().startswith("#fte:imslppage")) if m), {})
    blocks = []
    for m in (_named(t) for t in each if t[0].lower().startswith("#fte:imslpfile")):
        publisher = next((t for t in _bodies(m.get("Publisher Information", "")) if t[0] == "P"), None)
        blocks.append({"files": [v for k, v in m.items() if _FILE.fullmatch(k)], "editor": m.get("Editor"), "publisher": publisher})
    return {to: page.get(k) for to, k in _PAGE.items()} | {"blocks": blocks}


def _read_all(pages: pa.Array) -> pa.Array:
    texts = pa.list_(pa.string())
    kind = pa.struct([*[(to, pa.string()) for to in _PAGE], ("blocks", pa.list_(pa.struct([("files", texts), ("editor", pa.string()), ("publisher", texts)])))])
    return pa.array([_read(x) for x in pages.to_pylist()], kind)


def work_page(c: Column) -> Column:
    """struct(title, alternative, collection, instrumentation, first_year, first_source, editions) of a work's page.

    ``editions`` has the files, editor, printer, place and year of each block of files; a printer is what a publisher
    template names, wherever it nests. ``first_source`` is the number of the source catalogue given with the first
    publication. A null page has nulls and no editions; fields that are not closed are not read. Templates are taken apart in
    Arrow batches, so ``c`` may not be a lambda's variable.
    """
    ship(SparkSession.active())
    r = F.arrow_udf(_read_all, READ)(c)
    first = r["first"]
    flat = lambda e: F.struct(e["files"].alias("files"), e["editor"].alias("editor"), *[e["by"][f].alias(f) for f in ("printer", "full_name", "place", "year")])
    edition = lambda b: F.struct(b["files"].alias("files"), unlinked(b["editor"]).alias("editor"), _printer(b["publisher"]).alias("by"))
    return F.struct(
        unlinked(r["title"]).alias("title"), unlinked(r["alternative"]).alias("alternative"), F.coalesce(r["type"].rlike("(?i)collection"), F.lit(False)).alias("collection"), unlinked(r["instrumentation"]).alias("instrumentation"),
        F.nullif(year(first), F.lit(0)).alias("first_year"), F.nullif(F.regexp_extract(first, r"(?i)\{\{RISMc?\|(\d+)", 1), F.lit("")).alias("first_source"),
        F.transform(F.transform(r["blocks"], edition), flat).alias("editions"),
    )


def printer_is_person(person: Column, editions: Column) -> Column:
    """Whether a page's person ('Surname, Given') is the printer of one of its editions: the whole name, or the surname among at most four words."""
    parts = F.split(person, r"\s*,\s*")
    name = normalise(F.when(F.size(parts) == 2, F.concat_ws(" ", parts[1], parts[0])).otherwise(person))
    surname = normalise(parts[0])
    is_it = lambda x: F.coalesce((normalise(x) == name) | (F.length(surname) >= 4) & F.array_contains(tokens(x), surname) & (F.size(tokens(x)) <= 4), F.lit(False))
    return F.exists(editions, lambda e: is_it(e["printer"]) | is_it(e["full_name"]))


def edition_of_file(editions: Column, file: Column) -> Column:
    """The edition that lists a file, by its name with or without a number before it; else the only one with a printer."""
    plain = lambda x: normalise(F.regexp_replace(x, r"(?i)\.pdf$", ""))
    name = plain(file)
    lists = lambda e: F.exists(e["files"], lambda f: (name != "") & (plain(f) == name) | plain(f).endswith(F.concat(F.lit(" "), name)))
    printed = F.filter(editions, lambda e: e["printer"].isNotNull())
    return F.coalesce(F.get(F.filter(editions, lists), F.lit(0)), F.when(F.size(printed) == 1, F.get(printed, F.lit(0))))
