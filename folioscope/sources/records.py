"""Readers of reference lists and payloads: BibTeX, RIS, MARC-like XML, HTML tables, file folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RIS_TYPES = {"JOUR": "article-journal", "BOOK": "book", "CHAP": "chapter", "THES": "thesis", "CONF": "paper-conference", "MUSIC": "musical_score", "SOUND": "song"}
BIB_TYPES = {"article": "article-journal", "book": "book", "incollection": "chapter", "inproceedings": "paper-conference", "phdthesis": "thesis", "mastersthesis": "thesis", "misc": "document"}


def reference_format(c: Column) -> Column:
    """'ris' or 'bibtex' by what the text looks like."""
    return F.when(c.rlike(r"(?m)^TY  - "), "ris").when(c.rlike(r"(?m)^\s*@\w+\s*[{(]"), "bibtex")


def _mapped(c: Column, table: dict[str, str], other: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(other))


def read_ris(files: DataFrame) -> DataFrame:
    """``files(path, content)`` to entries: path, entry, type, title, authors, date, doi, isbn, publisher, place, url, notes, keywords."""
    each = files.select("path", F.posexplode(F.filter(F.split(F.regexp_replace("content", "\r\n?", "\n"), r"(?m)^ER  -.*$"), lambda e: e.rlike(r"(?m)^TY  - "))).alias("entry", "raw"))
    all_of = lambda tag: F.transform(F.regexp_extract_all("raw", F.lit(rf"(?m)^(?:{tag})  - (.*)$"), F.lit(1)), lambda x: F.trim(x))
    one = lambda tag: F.nullif(F.coalesce(F.get(all_of(tag), F.lit(0)), F.lit("")), F.lit(""))
    return each.select("path", "entry", _mapped(one("TY"), RIS_TYPES, "document").alias("type"), one("TI|T1").alias("title"), all_of("AU|A1").alias("authors"), F.regexp_replace(one("PY|Y1|DA"), "/", "-").alias("date"), F.lower(one("DO")).alias("doi"), one("SN").alias("isbn"), one("PB").alias("publisher"), one("CY").alias("place"), one("UR").alias("url"), one("N1").alias("notes"), all_of("KW").alias("keywords"))


def read_bibtex(files: DataFrame) -> DataFrame:
    """The same columns from BibTeX; values in braces (one level nested) or quotes; a missing key is allowed."""
    text = F.regexp_replace("content", "\r\n?", "\n")
    parts = F.split(text, r"(?m)^(?=\s*@\w+\s*[{(])")
    each = files.select("path", F.posexplode(F.filter(parts, lambda e: e.rlike(r"^\s*@\w+\s*[{(]") & ~e.rlike(r"(?i)^\s*@(comment|string|preamble)"))).alias("entry", "raw"))

    def field(name: str) -> Column:
        braces = F.regexp_extract("raw", rf"(?is)[,\s]{name}\s*=\s*\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}", 1)
        quotes = F.regexp_extract("raw", rf'(?is)[,\s]{name}\s*=\s*"([^"]*)"', 1)
        bare = F.regexp_extract("raw", rf"(?i)[,\s]{name}\s*=\s*(\d+)", 1)
        value = F.when(braces != "", braces).when(quotes != "", quotes).otherwise(bare)
        return F.nullif(F.trim(F.regexp_replace(F.translate(value, "{}", ""), r"\s+", " ")), F.lit(""))

    kind = F.lower(F.regexp_extract("raw", r"^\s*@(\w+)", 1))
    names = F.filter(F.split(F.coalesce(field("author"), F.lit("")), r"\s+and\s+"), lambda a: a != "")
    words = F.filter(F.split(F.coalesce(field("keywords"), F.lit("")), r"\s*[,;]\s*"), lambda a: a != "")
    return each.select("path", "entry", _mapped(kind, BIB_TYPES, "document").alias("type"), field("title").alias("title"), names.alias("authors"), F.coalesce(field("date"), field("year")).alias("date"), F.lower(field("doi")).alias("doi"), field("isbn").alias("isbn"), field("publisher").alias("publisher"), F.coalesce(field("address"), field("location")).alias("place"), field("url").alias("url"), field("note").alias("notes"), words.alias("keywords"))


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all .bib and .ris files under a folder, the format taken from the content."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    files = files.withColumn("format", reference_format(F.col("content")))
    return read_ris(files.where("format = 'ris'")).unionByName(read_bibtex(files.where("format = 'bibtex'")))


def probable_type(kind: Column, container: Column, volume: Column) -> Column:
    """A book with a container and a volume is an article, with a container alone a chapter."""
    return F.when((kind == "book") & container.isNotNull() & volume.isNotNull(), "article-journal").when((kind == "book") & container.isNotNull(), "chapter").otherwise(kind)


def xml_texts(xml: Column, name: str) -> Column:
    """Inner texts of all elements of a name, whatever the namespace, tags stripped and entities decoded."""
    inner = F.regexp_extract_all(xml, F.lit(rf"(?s)<(?:\w+:)?{name}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{name}>"), F.lit(1))
    return F.transform(inner, lambda t: decoded(F.regexp_replace(t, "<[^>]*>", "")))


def decoded(c: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def marc_fields(xml: Column) -> Column:
    """array<struct(tag, ind1, ind2, sub array<struct(code, value)>)> of MARC XML."""
    fields = F.regexp_extract_all(xml, F.lit(r"(?s)(<(?:\w+:)?datafield\s.*?</(?:\w+:)?datafield>)"), F.lit(1))

    def one(f: Column) -> Column:
        subs = F.regexp_extract_all(f, F.lit(r"(?s)(<(?:\w+:)?subfield\s.*?</(?:\w+:)?subfield>)"), F.lit(1))
        sub = F.transform(subs, lambda s: F.struct(F.regexp_extract(s, 'code="(.)"', 1).alias("code"), decoded(F.regexp_extract(s, "(?s)>(.*?)</", 1)).alias("value")))
        return F.struct(F.regexp_extract(f, 'tag="([0-9]{3})"', 1).alias("tag"), F.regexp_extract(f, 'ind1="(.)"', 1).alias("ind1"), F.regexp_extract(f, 'ind2="(.)"', 1).alias("ind2"), sub.alias("sub"))

    return F.transform(fields, one)


def marc_values(fields: Column, tag: str, codes: str, separator: str = " ") -> Column:
    """Subfields of a tag with one of the codes, joined, one string for each field."""
    mine = F.filter(fields, lambda f: f["tag"] == tag)
    return F.transform(mine, lambda f: F.array_join(F.transform(F.filter(f["sub"], lambda s: F.lit(codes).contains(s["code"])), lambda s: s["value"]), separator))


def html_pairs(html: Column) -> Column:
    """map(label, value) of two-cell table rows; the first of a repeated label stays."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>\s*<t[hd][^>]*>(.*?)</t[hd]>\s*<td[^>]*>.*?</td>\s*</tr>"), F.lit(1))
    values = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>\s*<t[hd][^>]*>.*?</t[hd]>\s*<td[^>]*>(.*?)</td>\s*</tr>"), F.lit(1))
    clean = lambda a: F.transform(a, lambda t: F.trim(decoded(F.regexp_replace(t, "<[^>]*>", ""))))
    pairs = F.arrays_zip(clean(rows).alias("k"), clean(values).alias("v"))
    first = F.aggregate(pairs, F.array().cast("array<struct<k:string,v:string>>"), lambda acc, p: F.when(F.exists(acc, lambda x: x["k"] == p["k"]), acc).otherwise(F.concat(acc, F.array(F.struct(p["k"].alias("k"), p["v"].alias("v"))))))
    return F.map_from_entries(first)


def files_under(spark: SparkSession, path: str, pattern: str = "*", aside: tuple[str, ...] = ()) -> DataFrame:
    """``path, size, modified, sha256`` of files under a folder, without dot files and side folders."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    f = f.where(~F.col("path").rlike(r"/\.[^/]*($|/)"))
    for a in aside:
        f = f.where(~F.col("path").contains(f"/{a}/"))
    return f.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def settings_map(settings: DataFrame) -> DataFrame:
    """One row: all key-value settings as a map (the last of a repeated key in key order wins)."""
    s = settings.groupBy("key").agg(F.max("value").alias("value"))
    return s.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("settings"))


def solr_docs(xml: Column) -> Column:
    """array<map(field, array of values)> of the docs of a Solr answer; a scalar is an array of one."""
    docs = F.regexp_extract_all(xml, F.lit("(?s)<doc>(.*?)</doc>"), F.lit(1))

    def fields(d: Column) -> Column:
        scalars = F.regexp_extract_all(F.regexp_replace(d, r"(?s)<arr .*?</arr>", ""), F.lit(r'(?s)(<(?:str|int|long|float|double|bool|date) name="[^"]+">.*?</)'), F.lit(1))
        one = F.transform(scalars, lambda s: F.struct(F.regexp_extract(s, 'name="([^"]+)"', 1).alias("k"), F.array(decoded(F.regexp_extract(s, "(?s)>(.*)</$", 1))).alias("v")))
        arrays = F.regexp_extract_all(d, F.lit(r'(?s)(<arr name="[^"]+">.*?</arr>)'), F.lit(1))
        many = F.transform(arrays, lambda a: F.struct(F.regexp_extract(a, 'name="([^"]+)"', 1).alias("k"), F.transform(F.regexp_extract_all(a, F.lit(r"(?s)<(?:str|int|long|float|double|bool|date)>(.*?)</"), F.lit(1)), decoded).alias("v")))
        return F.map_from_entries(F.concat(one, many))

    return F.transform(docs, fields)


def media_tags(probe: Column) -> Column:
    """struct(tags map with lower-case keys, duration) of a media probe's JSON answer."""
    p = F.from_json(probe, "format struct<duration:string,tags:map<string,string>>")
    return F.struct(F.transform_keys(p["format"]["tags"], lambda k, _: F.lower(k)).alias("tags"), p["format"]["duration"].try_cast("double").alias("duration"))


def zip_members(files: DataFrame, pattern: str, most: int = 1 << 24) -> DataFrame:
    """``path, member, content`` of the members of ZIP files(path, content) whose names match; larger members than ``most`` are an error."""
    import io
    import re
    import zipfile

    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["content"] is None or not zipfile.is_zipfile(io.BytesIO(r["content"])):
                    continue
                with zipfile.ZipFile(io.BytesIO(r["content"])) as z:
                    for m in z.infolist():
                        if re.search(pattern, m.filename) and not m.is_dir():
                            if m.file_size > most:
                                raise ValueError(f"{m.filename} in {r['path']} has {m.file_size} bytes")
                            rows.append((r["path"], m.filename, z.read(m)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary()))], names=["path", "member", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, member string, content binary")


def score_metadata(xml: Column) -> Column:
    """struct of a score's title, subtitle, composer, arranger, lyricist and rights: the first value that is no placeholder."""
    none = r"(?i)^\s*(\[?(title|subtitle|composer|arranger|lyricist|copyright|untitled)\]?)?\s*$"
    one = lambda n: F.get(F.filter(xml_texts(xml, n), lambda v: ~v.rlike(none)), F.lit(0)).alias(n)
    return F.struct(*[one(n) for n in ("title", "subtitle", "composer", "arranger", "lyricist", "rights")])
