"""A corpus cleaning pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Columns that a stage does not use travel through it in one struct, so no column of the input is ever replaced by a figure
of an operator that happens to have the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, decontaminate, langid, linededup, minhash, queries
from folioscope.operators.components import stored


def packed(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with the columns ``used``, and all others in the struct ``__rest``."""
    return docs.select(*used, F.struct(F.lit(0).alias("_"), *[F.col(c) for c in docs.columns if c not in used]).alias("__rest"))


def unpacked(found: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of ``docs``, out of ``found``."""
    return found.select(*[F.col(c) if c in used else F.col("__rest").getField(c).alias(c) for c in docs.columns])


def free(name: str, docs: DataFrame) -> str:
    """``name``, with as many underscores behind it as it takes to be no column of ``docs``."""
    while name in docs.columns:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; those without a letter or text, or with a null text, go.

    Where no language was learnt, nothing else is decided. Repeated rows and rows without an id are judged alike."""
    samples = langid.fit(docs)
    if not samples:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(packed(docs, "text"), samples)
    return unpacked(found.where(F.col("lang_pred") != langid.UNDETERMINED), docs, "text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less repeated runs of three lines; documents of which nothing is left go, null and empty texts stay. ``n_chars``, if there, follows the text."""
    out = linededup.dedup_lines(packed(docs, "doc_id", "text")).where("n_removed = 0 or n_removed < n_lines")
    if "n_chars" not in docs.columns:
        return unpacked(out, docs, "doc_id", "text")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("__rest.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[F.col(c) if c in ("doc_id", "text") else n_chars.alias(c) if c == "n_chars" else F.col("__rest").getField(c).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the one with the smallest doc_id.

    Rows that repeat it become one, the one whose text comes first; rows without an id, and documents without words, stay."""
    kept = minhash.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    named = packed(docs, "doc_id", "text").join(kept, "doc_id", "left_semi").withColumn("__n", F.expr("row_number() over (partition by doc_id order by text)")).where("__n = 1")
    return unpacked(named, docs, "doc_id", "text").union(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold a benchmark item (0.8 of its words); null and empty texts hold none, repeated rows are judged alike."""
    found = decontaminate.contamination(packed(docs, "text"), queries.table(spark, sf_dir, "benchmark"))
    return unpacked(found.where(~F.col("contaminated")), docs, "text")


def bpe_codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``token_ids`` of their text, ``n_tokens``, and ``round_trip``: whether the ids decode to the text again.

    A null or empty text has no ids and comes back. A name that the documents have already gets an underscore here."""
    ids, n, back = (free(name, docs) for name in ("token_ids", "n_tokens", "round_trip"))
    coded = bpe.bpe_encode(packed(docs, "text"), queries.VOCABULARY, ids="__ids", round_trip="__back")
    rest = [F.col(c) if c == "text" else F.col("__rest").getField(c).alias(c) for c in docs.columns]
    return coded.select(*rest, F.col("__ids").alias(ids), F.size("__ids").alias(n), F.col("__back").alias(back))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe_codes", bpe_codes),
]

#: Near-duplicate groups, tiling and BPE are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``documents`` that all stages keep, with the columns of the last."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
