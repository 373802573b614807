"""Scoring candidates, tie-aware choice, vetoes, filling the winner."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import similarity, text

CLOSE, CAP = 0.05, 0.5


def confidence(q_words: Column, c_words: Column, surname_found: Column | None = None, penalty: Column | None = None) -> Column:
    """Best of Dice and 0.9 containment; a quarter for the surname where known; penalties multiply; 2 decimals, half up."""
    s = F.greatest(similarity.dice_of(q_words, c_words), 0.9 * similarity.containment_of(q_words, c_words))
    if surname_found is not None:
        s = F.when(surname_found.isNotNull(), 0.75 * s + 0.25 * surname_found.cast("int")).otherwise(s)
    return similarity.round2(s * penalty if penalty is not None else s)


def confidence_of(shared: Column, query: Column, found: Column) -> Column:
    """The same from the numbers of words: shared, of the query, of the candidate."""
    dice = F.when((query > 0) & (found > 0), 2.0 * shared / (query + found)).otherwise(0.0)
    contained = F.when((query >= 3) & (found > 0), shared * 1.0 / query).otherwise(0.0)
    return similarity.round2(F.greatest(dice, 0.9 * contained))


def scores(shared: np.ndarray, found: np.ndarray, query: np.ndarray) -> np.ndarray:
    """:func:`confidence_of` of some candidates (first axis) for some queries; -1 without a shared word."""
    dice = 2.0 * shared / np.maximum(query + found, 1)
    contained = np.where(query >= 3, shared * 1.0 / np.maximum(query, 1), 0.0)
    return np.where(shared > 0, np.floor(np.maximum(dice, 0.9 * contained) * 100 + 0.5) / 100.0, -1.0)


def best(k: int) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Of some candidates those that may be among a query's best k: no less than the kth of them."""

    def keep(shared: np.ndarray, found: np.ndarray, query: np.ndarray) -> np.ndarray:
        s = scores(shared, found, query)
        return s >= np.partition(s, -k, axis=0)[-k] if len(s) > k else s >= 0

    return keep


def near_best(shared: np.ndarray, found: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Of some candidates those that may be as near to a query's best as ``fill_winner`` looks."""
    s = scores(shared, found, query)
    return s.max(axis=0) - s <= CLOSE + 1e-9


def earliest(candidates: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The keys, each once with its first ``arrival``, where nothing else is asked for: partial minima instead of a sort."""
    return candidates.groupBy(*keys).agg(F.min(arrival).alias(arrival))


def first_of(candidates: DataFrame, key: Column, query: str, arrival: str) -> DataFrame:
    """Of candidates with one key for a query, the first to arrive."""
    keyed = candidates.withColumn("__k", key)
    return keyed.withColumn("__r", F.expr(f"row_number() over (partition by {query}, __k order by {arrival})")).where("__r = 1").drop("__k", "__r")


def top(candidates: DataFrame, query: str, k: int, order: str) -> DataFrame:
    """Rank within each query, k rows at most; Spark keeps the k best of each task before the shuffle."""
    return candidates.withColumn("rank", F.expr(f"row_number() over (partition by {query} order by {order})")).where(F.col("rank") <= k)


def choose(candidates: DataFrame, query: str, work: str, threshold: float = 0.8) -> DataFrame:
    """``query, winner, confidence, decision`` from candidates(query, id, confidence, work): the best if it reaches the
    threshold and no other work comes within 0.05 of it (or also reaches 1)."""
    ranked = top(candidates, query, 2, "confidence desc, id")
    at = lambda r, *c: F.max(F.when(F.col("rank") == r, F.struct(*c)))  # noqa: E731  a row of each rank: candidates are read once
    both = ranked.groupBy(query).agg(at(1, F.col("id").alias("winner"), "confidence", F.col(work).alias("wa")).alias("a"), at(2, F.col("confidence").alias("cb"), F.col(work).alias("wb")).alias("b"))
    both = both.select(query, "a.*", *[F.when(F.col(query).isNotNull(), F.col(f"b.{c}")).alias(c) for c in ("cb", "wb")])
    same = F.coalesce(F.col("wa") == F.col("wb"), F.lit(False))
    near = F.when(F.col("confidence") >= 1, F.col("cb") >= 1).otherwise(F.col("confidence") - F.col("cb") <= CLOSE + 1e-9)
    tie = F.col("cb").isNotNull() & near & ~same
    decision = F.when(F.col("confidence") < threshold, "low").when(tie, "tie").otherwise("accepted")
    return both.select(query, "winner", "confidence", decision.alias("decision"))


def vetoed(candidates: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Confidence capped at 0.5 where any reason holds; ``reasons`` lists those that do."""
    why = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in reasons.items()]))
    out = candidates.withColumn("reasons", why)
    return out.withColumn("confidence", F.when(F.size("reasons") > 0, F.least("confidence", F.lit(CAP))).otherwise(F.col("confidence")))


def fill_winner(candidates: DataFrame, query: str, same: str, fields: list[str]) -> DataFrame:
    """Winners with empty fields filled from candidates of the same work within 0.05, best first."""
    over = f"over (partition by {query} order by confidence desc, id)"
    w = candidates.select(query, "id", "confidence", F.col(same).alias("__s"), *fields).withColumns({"__r": F.expr(f"row_number() {over}"), "__best": F.expr(f"first_value(struct(confidence, __s)) {over}")})
    near = (F.col("__r") > 1) & F.col(query).isNotNull() & F.col("__s").eqNullSafe(F.col("__best.__s")) & (F.col("__best.confidence") - F.col("confidence") <= CLOSE + 1e-9)
    filled = lambda f: near & ~text.is_blank(F.col(f))
    got = [F.min_by(F.when(filled(f), F.col(f)), F.when(filled(f), F.col("__r"))).alias(f"__{f}") for f in fields]
    best = F.max(F.when(F.col("__r") == 1, F.struct("id", "confidence", *fields))).alias("__w")
    out = w.groupBy(query).agg(best, *got)
    return out.select(query, "__w.id", "__w.confidence", *[text.first_filled(F.col(f"__w.{f}"), F.col(f"__{f}")).alias(f) for f in fields])


def replace_ok(same_id: Column, old_from_catalogue: Column, composers_shared: Column, same_number: Column, title_dice: Column) -> Column:
    """Whether a new candidate may replace an identification: always if that is not from a catalogue."""
    return ~old_from_catalogue | same_id | (composers_shared & F.coalesce(same_number, title_dice >= 0.8))
