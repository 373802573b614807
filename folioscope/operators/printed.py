"""First pages of prints: title, subtitle, persons, part, source and rights from where the words stand on the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import layout, text

#: Lines of a page that are looked at, lines of a header without a staff, and how far from the middle a centred cell may stand.
LINES, HEADER, CENTRED = 70, 14, 0.22


def _laid_out(pages: DataFrame, key: str, page: str) -> DataFrame:
    """``key, page, staff, cells`` for every row; a page's cells stay in its row, in reading order, so no page is moved or put together again."""
    lines = F.slice(F.split(F.replace(F.col(page), F.lit("\f"), F.lit("\n")), "\n", LINES + 1), 1, LINES)
    p = pages.select(F.col(key).alias("key"), F.col(page).alias("page"), F.coalesce(lines, F.array().cast("array<string>")).alias("lines"))
    margin = F.coalesce(F.array_min(F.transform(F.filter("lines", layout.music_line), lambda x: F.length(x) - F.length(F.ltrim(x)))), F.lit(0))
    longest = F.greatest(F.lit(60), F.array_max(F.transform("lines", lambda x: F.length(F.rtrim(x)))))
    staff = F.nullif(F.array_position(F.transform("lines", layout.staff_line), True), F.lit(0)) - 1
    p = p.select("key", "page", "lines", margin.alias("margin"), F.greatest(F.lit(40), longest - margin).alias("width"), staff.cast("int").alias("staff"))

    def placed(line: Column, at: Column, run: Column) -> Column:
        start = F.greatest(F.lit(0), run["start"] - F.col("margin"))
        end = F.greatest(start + 1, run["end"] - F.col("margin"))
        share = lambda x: x / F.col("width")
        return F.struct(line.alias("line"), at.alias("at"), layout.without_glyphs(run["text"]).alias("text"), share(start).alias("left"), share(end).alias("right"), share((start + end) / 2).alias("middle"))

    numbered = lambda x, line: F.transform(layout.runs(x), lambda run, at: F.struct(line.alias("line"), at.alias("at"), run.alias("run")))
    legible = F.filter(F.flatten(F.transform("lines", numbered)), lambda x: layout.legible(x["run"]["text"]))
    return p.select("key", "page", "staff", F.transform(legible, lambda x: placed(x["line"], x["at"], x["run"])).alias("cells"))


def cells(pages: DataFrame, key: str, page: str) -> DataFrame:
    """``key, line, at, text, left, right, middle, staff``: legible cells of each page's first ``LINES`` lines.

    Places are shares of the width between the left margin (the least indentation of lines of music, 0 without any) and the
    longest line. ``staff`` is the first line with a clef and a metre (null without one). Null pages have no cells.
    """
    each = _laid_out(pages, key, page).select("key", "staff", F.explode_outer("cells").alias("cell")).where("cell is not null")
    return each.select("key", *(f"cell.{x}" for x in ("line", "at", "text", "left", "right", "middle")), "staff")


def _more(cells: Column, **fields) -> Column:
    """The cells with more fields, each worked out once, of a cell and its place in the array."""

    def add(c: Column, i: Column) -> Column:
        out = c
        for name, f in fields.items():
            out = out.withField(name, f(c, i))
        return out

    return F.transform(cells, add)


def _heads(cells: Column) -> Column:
    """Header cells that are no label, song text or address, with their ``kind``, the ``name`` that a mark introduces, and whether the text is a ``person``."""
    limit = F.coalesce("staff", F.lit(HEADER))
    heads = F.filter(cells, lambda c: (c["line"] <= limit + 2) & ~c["label"] & ~layout.sung(c["text"]) & ~layout.web(c["text"]))
    joined = lambda t: F.when(t.contains("["), F.regexp_replace(t, layout.alike(r"\[(\p{L})\](\p{L})"), "$1$2")).otherwise(t)
    heads = F.filter(_more(heads, text=lambda c, _: joined(layout.unquoted(c["text"]))), lambda c: c["text"] != "")
    pick = lambda c, p, n: F.regexp_extract(c["text"], layout.alike(p), n)
    says = lambda c, p: c["text"].rlike(layout.alike(p))

    def kind(c: Column, i: Column) -> Column:
        return (
            F.when(says(c, r"(?i)^s\. ?[XVI]+\b"), "epoch").when(says(c, layout.EDITOR), F.when(layout.person(pick(c, layout.EDITOR, 2)), "editor").otherwise("none"))
            .when(c["anonymous"] & says(c, r"^\S+[\s,]+\S"), "anonymous").when(layout.source(c["text"]) & ~((i == 0) & says(c, r"^\d+\. *\p{L}")), "source")
            .when((c["marked"] != "") & layout.person(c["marked"]), "marked").otherwise("free")
        )

    heads = _more(heads, anonymous=lambda c, _: says(c, layout.ANONYMOUS), marked=lambda c, _: pick(c, layout.MARKED, 1))
    name = lambda c, _: F.when(c["kind"] == "editor", layout.bare_name(pick(c, layout.EDITOR, 2))).when(c["kind"] == "marked", c["marked"])
    return _more(_more(heads, kind=kind), name=name, person=lambda c, _: (c["kind"] == "free") & layout.person(c["text"]))


def first_pages(pages: DataFrame, key: str, page: str, known: DataFrame | None = None) -> DataFrame:
    """``key, title, subtitle, composers, editors, part, parts, sources, others, epoch, composed, catalogue, holder, year`` for every row of ``pages``.

    The header is what stands above the first staff line (the first ``HEADER`` lines without one), and two lines more for names.
    Title: the first centred cell that is free, in brackets only if there is no other, else the first free one on the left;
    subtitle: a centred cell one or two lines below. Composers: names that a mark introduces, then names with dates of life,
    with a surname among ``known(surname)``, or of two words at the right margin. A part is named only if one label alone stands
    on the page, on the left or in its upper left corner. ``key`` must be unique; a null or empty page has nulls and empty lists.
    """
    pars = layout.alike(r"(?i)\b(prima|secunda|seconda|tertia|terza)\s+pars\b")
    p = _laid_out(pages, key, page)
    p = p.select("key", "page", "staff", _more(F.col("cells"), label=lambda c, _: layout.part_label(c["text"]) & ~c["text"].rlike(pars)).alias("cells"))
    corner = lambda c: (c["left"] < 0.16) | (c["line"] <= 3) & (c["middle"] < 0.35)
    label = lambda c: layout.unbracketed(c["text"])
    labels = F.transform(F.filter("cells", lambda c: c["label"]), lambda c: F.struct(text.normalise(label(c)).alias("n"), label(c).alias("text"), corner(c).alias("corner")))
    p = p.select("key", "page", "staff", labels.alias("labels"), _heads(F.col("cells")).alias("heads"))
    surnames = lambda c: F.regexp_extract_all(text.normalise(layout.bare_name(c["text"])), F.lit(r"([a-z0-9]{3,})"), F.lit(1))
    if known is None:
        p = p.withColumn("hits", F.lit(None).cast("array<string>"))
    else:
        named = p.select("key", F.explode_outer(F.flatten(F.transform(F.filter("heads", lambda c: c["person"]), surnames))).alias("surname"))
        hits = named.join(known.select(text.normalise(F.col("surname")).alias("surname")).distinct(), "surname").groupBy("key").agg(F.collect_set("surname").alias("hits"))
        p = p.join(hits, "key", "left")
    vouched = lambda c: c["text"].rlike(layout.alike(layout.LIFE)) | F.col("hits").isNotNull() & F.arrays_overlap(surnames(c), "hits")
    titled = lambda c: c["text"].rlike(layout.alike(r"(?i)^(mr|capt)\.")) | c["text"].rlike(layout.alike(r"\s[(\[]\p{L}"))
    placed = lambda c: (c["left"] > 0.5) & (c["right"] > 0.8)
    several = lambda c: F.size(F.split(layout.bare_name(c["text"]), layout.alike(r"[\s.]+"))) > 1
    composer = lambda c, _: (c["kind"] == "free") & (c["anonymous"] | c["person"] & (vouched(c) | several(c) & (titled(c) | placed(c))))
    small = lambda c, _: F.substring(c["text"], 1, 1).rlike(r"^\p{Ll}")
    heads = _more(F.col("heads"), composer=composer, small=small, centred=lambda c, _: F.abs(c["middle"] - 0.5) < CENTRED, bracketed=lambda c, _: c["text"].startswith("[") | c["text"].startswith("("))
    limit = F.coalesce("staff", F.lit(HEADER))
    plain = lambda c, _: (c["kind"] == "free") & ~c["composer"] & (c["line"] <= limit) & ~c["text"].rlike(layout.alike(layout.DIRECTION))
    free = lambda c, _: c["plain"] & layout.meaning(c["text"]) & (~c["small"] | F.col("staff").isNotNull() & (c["line"] < F.col("staff")) & layout.two_words(c["text"]))
    heads = _more(_more(heads, plain=plain), free=free)
    p = p.withColumn("heads", heads)
    rank = lambda c: F.when(c["centred"], F.when(c["bracketed"], 2).otherwise(1)).when(c["left"] < 0.6, 3)
    titles = F.transform(F.filter("heads", lambda c: c["free"]), lambda c: F.when(rank(c).isNotNull(), F.struct(rank(c).alias("rank"), c["line"].alias("line"), c["at"].alias("at"), c["text"].alias("text"))))
    p = p.withColumn("top", F.array_min(titles))
    below = lambda c: c["free"] & c["centred"] & ~c["bracketed"] & c["line"].between(F.col("top.line") + 1, F.col("top.line") + 2)
    fits = lambda c: (F.length(c["text"]) <= 60) & layout.two_words(c["text"]) & ~c["person"] & ~c["small"]
    p = p.withColumn("under", F.get(F.filter(F.slice(F.filter("heads", below), 1, 1), fits), F.lit(0)))
    is_at = lambda c, where: F.coalesce((c["line"] == F.col(f"{where}.line")) & (c["at"] == F.col(f"{where}.at")), F.lit(False))
    other = lambda c: c["plain"] & ~c["small"] & ~is_at(c, "top") & ~is_at(c, "under")
    listed = lambda cond, value=lambda c: c["text"]: F.transform(F.filter("heads", cond), value)
    rights, catalogue = layout.rights(F.col("page")), F.regexp_extract("page", layout.alike(r"\b((?:BWV|BuxWV|HWV|TWV|RV|KV) ?\d+[a-z]?)"), 1)
    by_mark = listed(lambda c: c["kind"].isin("marked", "anonymous"), lambda c: F.coalesce(c["name"], F.lit("Anonymous")))
    names = F.transform("labels", lambda x: x["n"])
    parts = F.transform(F.filter("labels", lambda x, i: F.array_position(names, x["n"]) == i + 1), lambda x: x["text"])
    out = p.select(
        "key", F.regexp_replace("top.text", layout.alike(r"^\[([^\]]{2,60})\]$"), "$1").alias("title"), F.col("under.text").alias("subtitle"), F.concat(by_mark, listed(lambda c: c["composer"])).alias("composers"),
        listed(lambda c: c["kind"] == "editor", lambda c: c["name"]).alias("editors"), parts.alias("parts"), F.try_element_at("labels", F.lit(-1))["corner"].alias("corner"),
        listed(lambda c: (c["kind"] == "source") | (c["kind"] == "anonymous") & layout.source(c["text"])).alias("sources"), listed(other).alias("others"),
        F.array_max(listed(lambda c: c["kind"] == "epoch")).alias("epoch"), catalogue.alias("catalogue"), rights.alias("rights"),
    )
    dated = layout.alike(r"\s*[(\[]\s*((?:1[4-9]|20)\d\d)\??\s*[)\]]\s*")
    return out.select(
        F.col("key").alias(key), layout.trimmed(F.regexp_replace(F.regexp_replace("title", dated, " "), layout.alike(r"\s+"), " "), F.col("title")).alias("title"), "subtitle", "composers", "editors", "parts", "sources", "others", F.when(F.col("corner") & (F.size("parts") == 1), F.col("parts")[0]).alias("part"),
        "epoch", F.nullif(F.regexp_extract("title", dated, 1), F.lit("")).alias("composed"), F.nullif("catalogue", F.lit("")).alias("catalogue"), F.col("rights.holder").alias("holder"), F.col("rights.year").alias("year"),
    )
