"""Line deduplication over overlapping windows of three lines, in DataFrame operations only.

Every run of three consecutive lines is hashed (128 bits); runs found more than once anywhere keep their first
occurrence, and the positions that later occurrences cover are merged and removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.components import stored
from folioscope.operators.prefilter import marked

WINDOW = 3


def _windows(lines: Column, n: int) -> Column:
    """Array of 128-bit hashes of all runs of ``n`` lines, by position. Lines are bound to a variable: inside a lambda they would be split anew for each run."""
    def runs(bound: Column) -> Column:
        def run(i: Column) -> Column:
            part = [F.get(bound, i + j) for j in range(n)]
            return F.struct(F.xxhash64(*part).alias("h1"), F.xxhash64(F.lit(n), *part).alias("h2"))

        return F.when(F.size(bound) >= n, F.transform(F.sequence(F.lit(0), F.size(bound) - n), run))

    return F.transform(F.array(lines), runs)[0]


def removed_windows(docs: DataFrame, text: str = "text", n: int = WINDOW) -> DataFrame:
    """``k1, k2, at``: for each document with later occurrences, by its key, the sorted positions where these begin."""
    lines = F.split(text, "\n", -1)
    found = docs.where(F.col(text).isNotNull()).select("k1", "k2", "doc_id", F.posexplode(_windows(lines, n)).alias("at", "w"))
    found = found.select("k1", "k2", "w.h1", "w.h2", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2", "at").alias("place"))
    first = found.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").drop("last")
    later = found.join(first, ["h1", "h2"]).where("place > first")
    return later.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("place.at")).alias("at"))


def dedup_lines(docs: DataFrame, text: str = "text", n: int = WINDOW) -> DataFrame:
    """``docs`` with ``text`` less its repeated runs, ``n_lines`` and ``n_removed``.

    Lines end at LF and are compared as they are, blank ones too; runs do not cross documents. Occurrences are ordered by
    doc_id (null last), then position; the first stays. Rows that agree in doc_id and text are one document and are
    treated alike; of rows with one doc_id and different texts, the order is that of a hash. Null texts stay null with 0
    lines, a text of under three lines is left alone, a text that loses all its lines becomes empty. Columns called
    ``n_lines`` or ``n_removed`` are replaced, all others kept.
    """
    key = [F.col("doc_id").cast("long"), F.col(text)]
    work = docs.drop("n_lines", "n_removed")
    kept = work.columns
    work = work.withColumn("__k1", F.xxhash64(*key)).withColumn("__k2", F.xxhash64(F.lit(1), *key))
    slim = work.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col(text).alias(text))
    at = stored(removed_windows(slim, text, n), "covered").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("at").alias("__at"))
    # only texts that may lose lines are moved to meet their positions
    both = marked(work, F.col("__k1"), at, F.col("__k1"), "__maybe")
    out = both.where("__maybe").join(at, ["__k1", "__k2"], "left").unionByName(both.where("not __maybe").withColumn("__at", F.lit(None).cast("array<int>")))
    out = out.withColumn("__lines", F.split(text, "\n", -1))
    m, size = F.size("__at"), F.size("__lines")

    def gap(i: Column) -> Column:
        """Lines between the i-th removed run and the one before."""
        start = F.when(i == 0, 0).otherwise(F.get("__at", i - 1) + n)
        return F.struct(start.alias("start"), (F.when(i == m, size).otherwise(F.get("__at", i)) - start).alias("len"))

    gaps = F.filter(F.transform(F.sequence(F.lit(0), m), gap), lambda g: g["len"] > 0)
    left = F.when(F.col("__at").isNotNull(), F.flatten(F.transform(gaps, lambda g: F.slice("__lines", g["start"] + 1, g["len"])))).otherwise(F.col("__lines"))
    out = out.withColumn("__left", left)
    new_text = F.when(F.col("__at").isNull(), F.col(text)).otherwise(F.array_join("__left", "\n"))
    n_lines, n_left = (F.coalesce(F.when(F.col(text).isNotNull(), F.size(c)), F.lit(0)) for c in ("__lines", "__left"))
    return out.select(*[new_text.alias(text) if c == text else F.col(c) for c in kept], n_lines.alias("n_lines"), (n_lines - n_left).alias("n_removed"))


#: The same in DuckDB: ``documents`` to doc_id, n_lines, n_removed, kept_md5.
SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, i AS pos, lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2] AS run
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM l WHERE len(lines) >= 3)),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS r FROM w) WHERE r > 1),
covered AS (SELECT DISTINCT doc_id, pos + j AS pos FROM later, (SELECT unnest([0, 1, 2]) AS j)),
x AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM l),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n FROM x ANTI JOIN covered USING (doc_id, pos) GROUP BY doc_id)
SELECT l.doc_id, CAST(coalesce(len(lines), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(lines), 0) - coalesce(n, 0) AS INTEGER) AS n_removed,
       CASE WHEN l.text IS NOT NULL THEN md5(coalesce(kept.text, '')) END AS kept_md5
FROM l LEFT JOIN kept ON l.doc_id = kept.doc_id
"""
