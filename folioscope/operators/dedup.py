"""Exact, key-based and fingerprint duplicates of records, keepers and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import similarity, text
from folioscope.operators.components import stored
from folioscope.operators.prefilter import probably_in


def exact_groups(docs: DataFrame, content: str, key: str) -> DataFrame:
    """``content_sha256, keeper, n`` for contents that stand more than once; null contents are no duplicates."""
    hashed = docs.where(F.col(content).isNotNull()).select(key, F.sha2(F.col(content).cast("binary"), 256).alias("content_sha256"))
    return hashed.groupBy("content_sha256").agg(F.min(key).alias("keeper"), F.count("*").alias("n")).where("n > 1")


def duplicate_keys(title: Column, doi: Column | None = None, isbn: Column | None = None) -> Column:
    """array<struct(priority, key)>: DOI, ISBN, then the compact title (8 characters at least, cut to 30)."""
    t = text.compact_title(title)
    parts = [F.struct(F.lit(3).alias("priority"), F.when(F.length(t) >= 8, F.concat(F.lit("t:"), F.substring(t, 1, 30))).alias("key"))]
    if isbn is not None:
        d = F.regexp_replace(F.upper(isbn), "[^0-9X]", "")
        parts.insert(0, F.struct(F.lit(2).alias("priority"), F.when(d != "", F.concat(F.lit("isbn:"), d)).alias("key")))
    if doi is not None:
        d = F.lower(F.trim(doi))
        parts.insert(0, F.struct(F.lit(1).alias("priority"), F.when(d != "", F.concat(F.lit("doi:"), d)).alias("key")))
    return F.filter(F.array(*parts), lambda p: p["key"].isNotNull())


def key_duplicates(new: DataFrame, known: DataFrame) -> DataFrame:
    """``id, match, priority``: for each new record its first hit among known ones. Frames have id, title, date, keys.

    A title key also needs compatible years and equal titles. The known row with the smallest id wins within a priority.
    """
    a = new.select("id", F.col("title").alias("ta"), F.col("date").alias("da"), F.explode("keys").alias("k")).select("id", "ta", "da", "k.*")
    b = known.select(F.col("id").alias("match"), F.col("title").alias("tb"), F.col("date").alias("db"), F.explode("keys").alias("k")).select("match", "tb", "db", "k.key")
    pairs = a.join(b, "key").where("id <> match")
    pairs = pairs.where(~F.col("key").startswith("t:") | (similarity.years_ok(F.col("da"), F.col("db")) & similarity.title_equal(F.col("ta"), F.col("tb"))))
    return pairs.groupBy("id").agg(F.min(F.struct("priority", "match")).alias("x")).select("id", "x.match", "x.priority")


def title_duplicates(records: DataFrame) -> DataFrame:
    """``id, match``: for each of records(id, title) the smallest other id with an equal title by :func:`similarity.title_equal`.

    Titles under 8 compact characters match nothing. Copies of a title are one row; a longer title meets the shorter ones
    that it begins with by its own beginnings, so titles with a common beginning make no pairs among themselves.
    """
    end = F.regexp_extract(text.normalise(F.col("title")), r"(?:^| )" + similarity.PART, 1)
    t = records.select("id", text.compact_title(F.col("title")).alias("ct"), end.alias("end")).where(F.length("ct") >= 8)
    t = stored(t, "titles")  # read five times, and its rules cost more than its rows
    same = t.groupBy("ct").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    second = t.join(same, "ct").where("id > low").groupBy("ct").agg(F.min("low").alias("low"), F.min("id").alias("next"))
    nodes = stored(t.where(F.length("ct") >= 30).groupBy("ct", "end").agg(F.min("id").alias("first")), "nodes")
    n = F.length("ct")
    begins = nodes.where(n > 30).select("ct", "end", "first", F.explode(F.sequence(F.lit(30), n - 1)).alias("n"))
    begins = begins.select("ct", "end", "first", F.expr("substr(ct, 1, n)").alias("begin"), F.expr("substr(ct, n + 1)").alias("rest")).where(~F.col("rest").rlike("^" + similarity.PART))
    short = nodes.select(F.col("ct").alias("begin"), F.col("end").alias("end2"), F.col("first").alias("first2"))
    pairs = probably_in(begins, F.col("begin"), short, F.col("begin")).join(short, "begin").where("end = '' or end2 = '' or end = end2")
    met = pairs.select("ct", "end", F.col("first2").alias("m")).union(pairs.select("begin", "end2", "first")).groupBy("ct", "end").agg(F.min("m").alias("m"))
    out = t.join(second, "ct", "left").join(met, ["ct", "end"], "left")
    other = F.when(F.col("id") == F.col("low"), F.col("next")).otherwise(F.col("low"))
    return out.select("id", F.least(other, "m").alias("match")).where("match is not null")


def neighbour_bits(vector: Column, cell: int) -> Column:
    """Fingerprint of a vector: whether each mean of ``cell`` values is larger than the next one, as a string of bits."""
    def total(i: Column) -> Column:
        out = F.get(vector, i * cell).cast("double")
        for j in range(1, cell):
            out = out + F.get(vector, i * cell + j).cast("double")
        return out

    cells = F.transform(F.sequence(F.lit(0), F.floor(F.size(vector) / cell).cast("int") - 1), total)
    bits = lambda m: F.transform(F.sequence(F.lit(0), F.size(m) - 2), lambda i: F.when(F.get(m, i) > F.get(m, i + 1), "1").otherwise("0"))
    return F.array_join(F.get(F.transform(F.array(cells), bits), F.lit(0)), "")


def fingerprint_pairs(prints: DataFrame, n_bits: int, most: int, group: str) -> DataFrame:
    """``a, b, distance`` within a group for prints(id, bits) that differ in at most ``most`` bits.

    Cut into most + 1 bands, two such prints agree in one band, so an equi-join on bands finds every pair.
    """
    bands = most + 1
    cut = [round(i * n_bits / bands) for i in range(bands + 1)]
    band = F.array(*[F.struct(F.lit(i).alias("i"), F.substring("bits", cut[i] + 1, cut[i + 1] - cut[i]).alias("s")) for i in range(bands)])
    each = prints.select("id", group, "bits", F.explode(band).alias("band"))
    x, y = each.select(F.col("id").alias("a"), group, F.col("bits").alias("ba"), "band"), each.select(F.col("id").alias("b"), group, F.col("bits").alias("bb"), "band")
    return distance_pairs(x.join(y, [group, "band"]).where("a < b")).where(F.col("distance") <= most)


def distance_pairs(pairs: DataFrame) -> DataFrame:
    differ = F.size(F.filter(F.arrays_zip(F.split("ba", ""), F.split("bb", "")), lambda z: z["0"] != z["1"]))
    return pairs.select("a", "b", differ.cast("long").alias("distance")).distinct()


def keeper_score(state: Column, **present: Column) -> Column:
    """Points of a record: complete 1000, else 500; and the points of each filled field given as name=(condition * points)."""
    out = F.when(state == "complete", 1000).otherwise(500)
    for c in present.values():
        out = out + c
    return out


def merged(keep: DataFrame, drop: DataFrame, key: str, fields: list[str], arrays: list[str]) -> DataFrame:
    """Records kept, their empty fields filled and their arrays joined with those of the duplicate dropped."""
    d = drop.select(key, *[F.col(c).alias(f"__{c}") for c in [*fields, *arrays]])
    out = keep.join(d, key, "left")
    return out.select(key, *[text.first_filled(F.col(c), F.col(f"__{c}")).alias(c) for c in fields], *[F.array_union(F.coalesce(c, F.array()), F.coalesce(f"__{c}", F.array())).alias(c) for c in arrays])
