"""Citation styles (CSL 1.0): a style's XML is compiled to column expressions that write one bibliography entry for each item.

Items have ``type``, ``text: map<string, string>`` (variables), ``names: map<string, array<struct<family, given, literal>>>`` and
``dates: map<string, array<int>>`` (year, month, day). Every macro becomes one column, so none is computed twice; a null stands for
what writes nothing, so affixes and groups vanish with what they hold.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NS = "{http://purl.org/net/xbiblio/csl}"
LANG = "{http://www.w3.org/XML/1998/namespace}lang"
#: Formatting by output: what stands before and after italic and bold text, and what is escaped.
MARKUP = {
    "text": {"italic": ("", ""), "bold": ("", ""), "escapes": []},
    "html": {"italic": ("<i>", "</i>"), "bold": ("<b>", "</b>"), "escapes": [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]},
    "rtf": {"italic": (r"{\i ", "}"), "bold": (r"{\b ", "}"), "escapes": [("\\", "\\\\"), ("{", r"\{"), ("}", r"\}")]},
}
NAME_OPTIONS = ("and", "delimiter-precedes-last", "et-al-min", "et-al-use-first", "initialize-with", "name-as-sort-order", "sort-separator")


def _tag(e: ElementTree.Element) -> str:
    return e.tag.removeprefix(NS)


@dataclass
class Locale:
    """Terms by (name, form) as (singular, plural), and date formats by form as elements."""

    terms: dict[tuple[str, str], tuple[str, str]] = field(default_factory=dict)
    dates: dict[str, ElementTree.Element] = field(default_factory=dict)

    def add(self, root: ElementTree.Element) -> Locale:
        for t in root.iter(f"{NS}term"):
            one, many = t.find(f"{NS}single"), t.find(f"{NS}multiple")
            plain = (t.text or "").strip() if one is None else (one.text or "").strip()
            self.terms[t.get("name", ""), t.get("form", "long")] = (plain, plain if many is None else (many.text or "").strip())
        for d in root.iter(f"{NS}date"):
            if d.get("form"):
                self.dates[d.get("form", "")] = d
        return self

    def term(self, name: str, form: str = "long", plural: bool = False) -> str:
        """A term; a form that is not there falls back to the next longer one."""
        for f in {"verb-short": ("verb-short", "verb", "long"), "symbol": ("symbol", "short", "long")}.get(form, (form, "long")):
            if (name, f) in self.terms:
                return self.terms[name, f][plural]
        return ""


@dataclass
class Written:
    """What an element writes (null: nothing), whether it depends on variables at all, and whether one of these is there."""

    text: Column
    varies: bool
    filled: Column


def styles_in(folder: str) -> dict[str, str]:
    """Styles of a folder by name, with their XML; locales are ``locales-xx-XX.xml`` beside them."""
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted(Path(folder).glob("*.csl"))}


def _nothing() -> Column:
    return F.lit(None).cast("string")


def _either(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _in_a_call(c: Column) -> Column:
    """``c`` as a lambda's result: it is evaluated as it stands, where code generated for a whole style would be too long to compile."""
    return F.get(F.transform(F.array(F.lit(0)), lambda _: c), F.lit(0))


class Style:
    """A style with a locale; ``bibliography`` writes its entries."""

    def __init__(self, xml: str, locale: str | None = None, markup: str = "text"):
        self.root = ElementTree.fromstring(xml)
        self.locale = Locale()
        if locale:
            self.locale.add(ElementTree.fromstring(locale))
        for own in self.root.findall(f"{NS}locale"):  # a style's own terms go before the locale's
            self.locale.add(own)
        self.markup = MARKUP[markup]
        self.macros = {m.get("name", ""): m for m in self.root.findall(f"{NS}macro")}
        self.section = self.root.find(f"{NS}bibliography")
        if self.section is None:
            raise ValueError("the style has no bibliography")
        self.written: dict[str, Written] = {}
        self.columns: dict[str, Column] = {}

    # variables -----------------------------------------------------------------------------------------------------------

    def _variable(self, name: str) -> Column:
        c = F.nullif(F.trim(F.element_at("text", F.lit(name))), F.lit(""))
        for sign, safe in self.markup["escapes"]:
            c = F.replace(c, F.lit(sign), F.lit(safe))
        return c

    def _there(self, name: str) -> Column:
        """Whether an item has a variable, a name or a date."""
        named = F.coalesce(F.size(F.element_at("names", F.lit(name))) > 0, F.lit(False))
        dated = F.coalesce(F.size(F.element_at("dates", F.lit(name))) > 0, F.lit(False))
        return self._variable(name).isNotNull() | named | dated

    # elements ------------------------------------------------------------------------------------------------------------

    def _formatted(self, e: ElementTree.Element, c: Column) -> Column:
        case = e.get("text-case")
        if e.get("strip-periods") == "true":
            c = F.replace(c, F.lit("."), F.lit(""))
        if case in ("lowercase", "uppercase"):
            c = F.lower(c) if case == "lowercase" else F.upper(c)
        elif case in ("capitalize-first", "sentence"):
            c = F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))
        elif case in ("capitalize-all", "title"):
            c = F.initcap(c)
        if e.get("quotes") == "true":
            c = F.concat(F.lit(self.locale.term("open-quote") or "“"), c, F.lit(self.locale.term("close-quote") or "”"))
        for kind, wanted in (("italic", e.get("font-style") == "italic"), ("bold", e.get("font-weight") == "bold")):
            if wanted:
                c = F.concat(F.lit(self.markup[kind][0]), c, F.lit(self.markup[kind][1]))
        return F.concat(F.lit(e.get("prefix", "")), c, F.lit(e.get("suffix", "")))

    def _macro(self, name: str) -> Written:
        if name not in self.written:
            w = self._all(list(self.macros[name]), "")
            column = f"__macro_{len(self.columns)}"
            self.columns[column] = _in_a_call(w.text)
            self.written[name] = Written(F.col(column), w.varies, F.col(column).isNotNull() if w.varies else F.lit(False))
        return self.written[name]

    def _all(self, elements: list[ElementTree.Element], delimiter: str) -> Written:
        parts = [self._write(x) for x in elements]
        text = F.nullif(F.concat_ws(delimiter, *[p.text for p in parts]), F.lit("")) if parts else _nothing()
        return Written(text, any(p.varies for p in parts), _either([p.filled for p in parts if p.varies]))

    def _write(self, e: ElementTree.Element) -> Written:
        return getattr(self, f"_{_tag(e).replace('-', '_')}_element")(e)

    def _text_element(self, e: ElementTree.Element) -> Written:
        if (name := e.get("variable")) is not None:
            c = F.coalesce(self._variable(f"{name}-short"), self._variable(name)) if e.get("form") == "short" else self._variable(name)
            return Written(self._formatted(e, c), True, c.isNotNull())
        if (name := e.get("macro")) is not None:
            w = self._macro(name)
            return Written(self._formatted(e, w.text), w.varies, w.filled)
        value = e.get("value") or self.locale.term(e.get("term", ""), e.get("form", "long"), e.get("plural") == "true")
        return Written(self._formatted(e, F.lit(value)) if value else _nothing(), False, F.lit(False))

    def _number_element(self, e: ElementTree.Element) -> Written:
        c = self._variable(e.get("variable", ""))
        return Written(self._formatted(e, c), True, c.isNotNull())

    def _label_element(self, e: ElementTree.Element) -> Written:
        name = e.get("variable", "")
        one, many = (self.locale.term(name, e.get("form", "long"), p) for p in (False, True))
        c = self._variable(name)
        several = c.rlike(r"\d\s*[-–,&]\s*\d") if e.get("plural", "contextual") == "contextual" else F.lit(e.get("plural") == "always")
        return Written(F.when(c.isNotNull(), self._formatted(e, F.when(several, many).otherwise(one))), True, c.isNotNull())

    def _group_element(self, e: ElementTree.Element) -> Written:
        w = self._all(list(e), e.get("delimiter", ""))
        text = self._formatted(e, w.text)
        return Written(F.when(w.filled, text) if w.varies else text, w.varies, w.filled)

    def _choose_element(self, e: ElementTree.Element) -> Written:
        text, filled, varies = None, None, False
        for branch in e:
            w = self._all(list(branch), "")
            varies |= w.varies
            cond = self._condition(branch) if _tag(branch) != "else" else F.lit(True)
            text = F.when(cond, w.text) if text is None else text.when(cond, w.text)
            filled = F.when(cond, w.filled) if filled is None else filled.when(cond, w.filled)
        return Written(text, varies, F.coalesce(filled, F.lit(False))) if text is not None else Written(_nothing(), False, F.lit(False))

    def _condition(self, e: ElementTree.Element) -> Column:
        tests: list[Column] = [F.col("type") == t for t in e.get("type", "").split()]
        tests += [self._there(v) for v in e.get("variable", "").split()]
        tests += [F.coalesce(self._variable(v).rlike(r"^[A-Za-z]{0,2}\d+[A-Za-z]{0,2}(\s*[-–,&]\s*\d+)*$"), F.lit(False)) for v in e.get("is-numeric", "").split()]
        tests += [F.lit(False)] * sum(len(e.get(a, "").split()) for a in ("position", "locator", "is-uncertain-date", "disambiguate"))
        if not tests:
            return F.lit(False)
        match = e.get("match", "all")
        return ~_either(tests) if match == "none" else _either(tests) if match == "any" else reduce(lambda a, b: a & b, tests)

    # dates ---------------------------------------------------------------------------------------------------------------

    def _date_element(self, e: ElementTree.Element) -> Written:
        parts = F.element_at("dates", F.lit(e.get("variable", "")))
        shape = self.locale.dates.get(e.get("form", ""))
        wanted = {"year": ["year"], "year-month": ["year", "month"]}.get(e.get("date-parts", ""), ["year", "month", "day"])
        own = {p.get("name"): p for p in e.findall(f"{NS}date-part")}
        if shape is None:
            pieces, delimiter = list(e.findall(f"{NS}date-part")), e.get("delimiter", "")
        else:
            pieces, delimiter = [p for p in shape.findall(f"{NS}date-part") if p.get("name") in wanted], shape.get("delimiter", "")
        out = [self._formatted(p, self._date_part(p if shape is None else own.get(p.get("name"), p), parts)) for p in pieces]
        there = F.coalesce(F.size(parts) > 0, F.lit(False))
        return Written(F.when(there, self._formatted(e, F.nullif(F.concat_ws(delimiter, *out), F.lit("")))), True, there)

    def _date_part(self, p: ElementTree.Element, parts: Column) -> Column:
        at = {"year": 0, "month": 1, "day": 2}[p.get("name", "year")]
        number = F.get(parts, F.lit(at))
        digits = F.lpad(number.cast("string"), 2, "0") if p.get("form") == "numeric-leading-zeros" else number.cast("string")
        if at == 1 and p.get("form", "long") in ("long", "short"):
            names = [self.locale.term(f"month-{m:02d}", p.get("form", "long")) for m in range(1, 13)]
            return F.coalesce(F.nullif(F.get(F.array(*map(F.lit, names)), number - 1), F.lit("")), digits)
        return digits

    # names ---------------------------------------------------------------------------------------------------------------

    def _names_element(self, e: ElementTree.Element) -> Written:
        name = e.find(f"{NS}name")
        options = {k: self.section.get(k) or self.root.get(k) for k in NAME_OPTIONS} | {"delimiter": self.section.get("name-delimiter") or self.root.get("name-delimiter"), "form": self.section.get("name-form") or self.root.get("name-form")}
        if name is not None:
            options |= dict(name.attrib)
        label = e.find(f"{NS}label")
        rows = []
        for v in e.get("variable", "").split():
            people = F.element_at("names", F.lit(v))
            listed = self._people(people, options)
            if label is not None:
                one, many = (self._formatted(label, F.lit(t)) if (t := self.locale.term(v, label.get("form", "long"), p)) else F.lit("") for p in (False, True))
                before = name is not None and list(e).index(label) < list(e).index(name)
                term = F.when(F.size(people) > 1, many).otherwise(one)
                listed = F.concat(term, listed) if before else F.concat(listed, term)
            rows.append(F.when(F.size(people) > 0, listed))
        text = self._formatted(e, F.nullif(F.concat_ws(e.get("delimiter", ", "), *rows), F.lit("")))
        there = _either([F.coalesce(F.size(F.element_at("names", F.lit(v))) > 0, F.lit(False)) for v in e.get("variable", "").split()])
        substitute = e.find(f"{NS}substitute")
        for other in [] if substitute is None else list(substitute):
            if _tag(other) == "names" and not len(other):  # takes over the name and label of the element it stands for
                whole = ElementTree.Element(other.tag, dict(other.attrib))
                whole.extend([x for x in (name, label) if x is not None])
                other = whole
            w = self._write(other)
            text, there = F.coalesce(text, w.text), there | w.filled
        return Written(text, True, there)

    def _people(self, people: Column, o: dict[str, str | None]) -> Column:
        """The names of an array as the options say: initials, order, 'and', 'et al.'."""
        initial = o.get("initialize-with")
        separator = F.lit(o.get("sort-separator") or ", ")

        def given(p: Column) -> Column:
            if initial is None:
                return p["given"]
            letters = F.transform(F.filter(F.split(p["given"], r"[\s.]+"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit(initial)))
            return F.trim(F.array_join(letters, ""))

        def whole(p: Column, i: Column) -> Column:
            natural = F.concat_ws(" ", F.nullif(given(p), F.lit("")), p["family"])
            if o.get("form") == "short":
                natural = p["family"]
            elif o.get("name-as-sort-order"):
                turned = F.concat(p["family"], F.coalesce(F.concat(separator, F.nullif(given(p), F.lit(""))), F.lit("")))
                natural = turned if o["name-as-sort-order"] == "all" else F.when(i == 0, turned).otherwise(natural)
            out = F.coalesce(F.nullif(p["literal"], F.lit("")), natural)
            for sign, safe in self.markup["escapes"]:
                out = F.replace(out, F.lit(sign), F.lit(safe))
            return out

        written = F.transform(people, whole)
        delimiter = o.get("delimiter") or ", "
        n = F.size(written)
        word = {"text": self.locale.term("and") or "and", "symbol": "&"}.get(o.get("and") or "")
        joined = F.array_join(written, delimiter)
        if word:
            rule = o.get("delimiter-precedes-last") or "contextual"
            comma = F.lit(rule == "always") if rule in ("always", "never") else n > 2 if rule == "contextual" else F.lit(o.get("name-as-sort-order") == "all")
            tie = F.when(comma, delimiter.rstrip() + f" {word} ").otherwise(f" {word} ")
            joined = F.when(n > 1, F.concat(F.array_join(F.slice(written, F.lit(1), F.greatest(n - 1, F.lit(0))), delimiter), tie, F.element_at(written, -1))).otherwise(joined)
        if o.get("et-al-min"):
            first = int(o.get("et-al-use-first") or 1)
            others = self.locale.term("et-al") or "et al."
            joined = F.when(n >= int(o["et-al-min"]), F.concat(F.array_join(F.slice(written, 1, first), delimiter), F.lit((" " if first == 1 else delimiter) + others))).otherwise(joined)
        return joined

    # entries -------------------------------------------------------------------------------------------------------------

    def bibliography(self, items: DataFrame) -> DataFrame:
        """``items`` with ``entry`` (points and blanks that meet are one), and ``sort_keys`` by which the style orders its entries."""
        layout = self.section.find(f"{NS}layout")
        entry = self._formatted(layout, self._all(list(layout), layout.get("delimiter", "")).text)
        keys = []
        for k in self.section.findall(f"{NS}sort/{NS}key"):
            c = self._macro(k.get("macro", "")).text if k.get("macro") else F.coalesce(self._variable(k.get("variable", "")), F.array_join(F.transform(F.element_at("dates", F.lit(k.get("variable", ""))), lambda x: F.lpad(x.cast("string"), 4, "0")), "-"))
            keys.append(F.coalesce(F.lower(c), F.lit("")))
        out = items
        for name, c in self.columns.items():  # in the order of their use: a macro's own macros come before it
            out = out.withColumn(name, c)
        tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(entry, r"\.(</i>|</b>|[”\"}])?\.+", ".$1"), r" {2,}", " "), r" ([,.;:])(?=\s|$)", "$1")
        return out.withColumn("entry", _in_a_call(F.trim(tidy))).withColumn("sort_keys", _in_a_call(F.array(*keys)) if keys else F.array().cast("array<string>")).drop(*self.columns)
