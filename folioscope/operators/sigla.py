"""Libraries by their sigla, full, abbreviated or by city, and sources by siglum and shelfmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators.components import stored
from folioscope.operators.linkage import cascade

SHAPE = r"^([A-Z]{1,3})-([A-Z][A-Za-z]*)$"
CONFIDENCE = 0.97


def _parts(siglum: Column) -> dict[str, Column]:
    library = F.regexp_extract(siglum, SHAPE, 2)
    return {"country": F.regexp_extract(siglum, SHAPE, 1), "two": F.substring(library, 1, 2), "rest": F.substring(library, F.lit(3), F.length(library))}


def in_order(letters: Column, word: Column) -> Column:
    """Whether all of ``letters`` stand in ``word`` in their order, others between them or not."""
    left = F.aggregate(F.split(word, ""), letters, lambda rest, c: F.when(F.substring(rest, 1, 1) == c, F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest))
    return left == ""


def libraries(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``id, siglum, step`` for ``asked(id, name)`` by ``known(siglum, city)``; what has no or no single answer is left out.

    In this order: the siglum itself (step 0); one it abbreviates (1): the same country, the same first two letters, its other
    letters in order among the full one's; a city with one library (2). A step with several answers ends the search.
    Abbreviations are met by country, first two letters and third letter: a full siglum stands under each letter it goes on with, so
    no country is compared with itself. Nulls meet nothing; repeated rows count once.
    """
    a = stored(asked.select("id", F.trim("name").alias("name")).distinct(), "asked")
    k = stored(known.where("siglum is not null").distinct(), "known")
    exact = a.join(k.select("siglum").distinct(), F.col("name") == F.col("siglum")).select("id", "siglum")
    short = a.where(F.col("name").rlike(SHAPE)).select("id", "name", *[c.alias(f"s_{n}") for n, c in _parts(F.col("name")).items()])
    full = k.where(F.col("siglum").rlike(SHAPE)).select("siglum", *[c.alias(n) for n, c in _parts(F.col("siglum")).items()]).distinct()
    letters = F.array_union(F.array(F.lit("")), F.split("rest", ""))
    full = full.withColumn("third", F.explode(letters))
    short = short.withColumn("third", F.substring("s_rest", 1, 1)).withColumnsRenamed({"s_country": "country", "s_two": "two"})
    met = short.join(full, ["country", "two", "third"])
    abbreviated = met.where(in_order(F.col("s_rest"), F.col("rest"))).select("id", "siglum").distinct()
    city = a.withColumn("city_key", text.normalise(F.col("name"))).join(k.select("siglum", text.normalise(F.col("city")).alias("city_key")).where("city_key <> ''").distinct(), "city_key").select("id", "siglum")
    return cascade([exact, abbreviated, city], "id", "siglum")


def shelfmark_keys(shelfmark: Column) -> list[Column]:
    """A shelfmark by ever fewer of its signs: as it stands, without points, without signs and blanks, and with numbers less their leading zeros."""
    low = F.trim(F.regexp_replace(F.lower(text.fold(shelfmark)), r"\s+", " "))
    bare = F.regexp_replace(low, r"[^a-z0-9]+", "")
    return [low, F.trim(F.regexp_replace(F.regexp_replace(low, r"[.,]+", " "), r"\s+", " ")), bare, F.regexp_replace(F.regexp_replace(low, r"(^|[^0-9])0+([0-9])", "$1$2"), r"[^a-z0-9]+", "")]


def sources(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``id, source, step, confidence`` for ``asked(id, siglum, shelfmark)`` by ``known(source, siglum, shelfmark)``: the siglum must be equal, the shelfmark by the first of its keys that has an answer; several answers are none."""
    steps = []
    for i in range(4):
        keyed = lambda f, c: f.select(c, "siglum", shelfmark_keys(F.col("shelfmark"))[i].alias("key")).where("siglum is not null and key <> ''").distinct()  # noqa: B023, E731
        steps.append(keyed(asked, "id").join(keyed(known, "source"), ["siglum", "key"]).select("id", "source"))
    return cascade(steps, "id", "source").withColumn("confidence", F.lit(CONFIDENCE))
