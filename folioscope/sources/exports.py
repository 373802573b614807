"""Exports: CSL-JSON, BibTeX, RIS, Markdown notes, text blocks, incremental copies, audit lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 100


def csl_json(records: DataFrame) -> DataFrame:
    """``id, json`` from id, type, title, authors array<struct(surname, given)>, year, publisher, place, doi, isbn, url."""
    people = F.transform("authors", lambda a: F.struct(a["surname"].alias("family"), a["given"].alias("given")))
    issued = F.when(F.col("year") > 0, F.struct(F.array(F.array("year")).alias("date-parts")))
    item = F.struct(F.col("id").cast("string").alias("id"), "type", "title", people.alias("author"), issued.alias("issued"), "publisher", F.col("place").alias("publisher-place"), F.col("doi").alias("DOI"), F.col("isbn").alias("ISBN"), F.col("url").alias("URL"))
    return records.select("id", F.to_json(item).alias("json"))


def _names(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.concat_ws(", ", x["surname"], x["given"])), " and ")


def bibtex(records: DataFrame, key: str) -> DataFrame:
    fields = [("title", F.col("title")), ("author", F.when(F.size("authors") > 0, _names(F.col("authors")))), ("year", F.when(F.col("year") > 0, F.col("year").cast("string"))), ("publisher", F.col("publisher")), ("address", F.col("place")), ("doi", F.col("doi")), ("isbn", F.col("isbn")), ("url", F.col("url"))]
    lines = F.array_compact(F.array(*[F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"  {n} = {{"), c, F.lit("}"))) for n, c in fields]))
    kind = F.when(F.col("type") == "article-journal", "article").when(F.col("type") == "chapter", "incollection").when(F.col("type") == "thesis", "phdthesis").when(F.col("type") == "book", "book").otherwise("misc")
    return records.select("id", F.concat(F.lit("@"), kind, F.lit("{"), F.col(key), F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}")).alias("entry"))


def ris(records: DataFrame) -> DataFrame:
    kind = F.when(F.col("type") == "article-journal", "JOUR").when(F.col("type") == "chapter", "CHAP").when(F.col("type") == "thesis", "THES").when(F.col("type") == "book", "BOOK").otherwise("GEN")
    line = lambda tag, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{tag}  - "), c))
    people = F.transform("authors", lambda x: F.concat(F.lit("AU  - "), F.concat_ws(", ", x["surname"], x["given"])))
    year = F.when(F.col("year") > 0, F.col("year").cast("string"))
    body = F.array_compact(F.concat(F.array(line("TY", kind), line("TI", F.col("title"))), people, F.array(line("PY", year), line("PB", F.col("publisher")), line("CY", F.col("place")), line("DO", F.col("doi")), line("SN", F.col("isbn")), line("UR", F.col("url")), F.lit("ER  - "))))
    return records.select("id", F.array_join(body, "\n").alias("entry"))


def notes_markdown(notes: DataFrame, record: str, title: str) -> DataFrame:
    """``record, markdown`` from notes(record, title, ord, kind, location, text, tags): quotations quoted, tags as hashtags."""
    n = F.struct("ord", "kind", "location", "text", "tags")
    g = notes.groupBy(record).agg(F.first(title).alias("t"), F.sort_array(F.collect_list(n)).alias("n"))
    one = lambda x: F.concat_ws(" ", F.when(x["kind"] == "quotation", F.concat(F.lit("> "), x["text"])).otherwise(x["text"]), F.when(x["location"] != "", F.concat(F.lit("("), x["location"], F.lit(")"))), F.array_join(F.transform(x["tags"], lambda t: F.concat(F.lit("#"), F.replace(t, F.lit(" "), F.lit("-")))), " "))
    return g.select(record, F.concat(F.lit("## "), F.col("t"), F.lit("\n\n"), F.array_join(F.transform("n", one), "\n\n")).alias("markdown"))


def text_blocks(texts: DataFrame, number: str, path: str) -> None:
    """Texts in blocks of 100 record numbers, one folder each; empty texts are left out."""
    kept = texts.where((F.col("content").isNotNull()) & (F.col("content") != ""))
    kept.withColumn("block", F.ceil(F.col(number) / BLOCK).cast("long")).repartition("block").write.mode("overwrite").partitionBy("block").json(path)


def latest_text(texts: DataFrame, key: str, updated: str, most: int = 8_000_000) -> DataFrame:
    """The newest text of each record, NUL removed, cut to the store's limit."""
    g = texts.groupBy(key).agg(F.max_by("content", updated).alias("content"))
    return g.select(key, F.substring(F.replace("content", F.lit("\u0000"), F.lit("")), 1, most).alias("content"))


def append_audit(changes: DataFrame, path: str) -> None:
    changes.withColumn("day", F.current_date()).write.mode("append").partitionBy("day").json(path)


def static_plan(required: DataFrame, present: DataFrame, previous: DataFrame) -> DataFrame:
    """``path, action, source`` for a static copy, from manifests(path, sha256) of what it needs, holds, and held last time.

    'up to date', 'copy', 'renamed' (``source`` is a file no longer needed with the same content, the first by name),
    'delete' (not needed, and the copy made it), 'junk' (not needed, and not made by the copy: it is left alone).
    """
    gone = present.join(required.select("path"), "path", "left_anti")
    again = gone.groupBy("sha256").agg(F.min("path").alias("source"))
    here = present.select("path", F.col("sha256").alias("held"))
    need = required.select("path", "sha256").join(here, "path", "left").join(again, "sha256", "left")
    same = F.coalesce(F.col("held") == F.col("sha256"), F.lit(False))
    renamed = ~same & F.col("source").isNotNull()
    action = F.when(same, "up to date").when(renamed, "renamed").otherwise("copy")
    made = previous.select("path", F.lit(True).alias("made")).distinct()
    rest = gone.select("path").join(made, "path", "left").select("path", F.when(F.col("made"), "delete").otherwise("junk").alias("action"), F.lit(None).cast("string").alias("source"))
    return need.select("path", action.alias("action"), F.when(renamed, F.col("source")).alias("source")).unionByName(rest)


def static_apply(blocks: DataFrame, plan_totals: dict[str, int], path: str, most_deleted: float = 0.5) -> None:
    """Writes the changed ``blocks`` (a column ``block`` and their rows) over those of a copy by block; the others stay.

    ``plan_totals`` are the plan's counts by action. A plan that would delete more than that share of what is there is
    refused, since a missing source looks like that. Each block is replaced whole when the write commits.
    """
    deleted = plan_totals.get("delete", 0)
    there = deleted + sum(plan_totals.get(a, 0) for a in ("up to date", "renamed"))
    if deleted > most_deleted * there:
        raise ValueError(f"refused: the plan deletes {deleted} of {there} files")
    blocks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block").parquet(path)
