"""Language identification by cross-parsing entropy.

Each language's labelled text becomes a suffix automaton. A text is parsed greedily against it: each phrase is the
longest match found anywhere in that language's text, and the language that needs fewest phrases per byte wins. The
automata are held as one table of transitions in which a dead end leads on from the root and counts one phrase, so that
thousands of blocks of text advance one byte at a time, all languages together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm import kernels as K
from folioscope.operators.ship import ship

#: Labelled text per language, all languages together, and taken from one document, in bytes: the documented bounds of the fitted sample.
PER_LANGUAGE, IN_ALL, PER_DOCUMENT = 48_000, 2_000_000, 400
#: Texts are parsed in blocks of so many normalised bytes, each begun afresh.
BLOCK = 512
UNDETERMINED = "und"

FOLD = np.full(256, 32, np.uint8)  # all but letters becomes a blank
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def normalised(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters lower-cased, every run of other bytes one blank; and where each text then begins."""
    x = FOLD[data]
    blank = x == 32
    first = np.zeros(len(x), bool)
    first[at[:-1][at[:-1] < len(x)]] = True
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep |= first
    return x[keep], np.concatenate(([0], np.cumsum(keep)))[at]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads exactly the substrings of ``text``; state 0 is the root."""
    move, link, length, last = [{}], [-1], [0], 0
    for c in text:
        now = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = now
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                clone = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    return move


class CrossParser:
    """Phrase counts of texts against each language's labelled text."""

    def __init__(self, samples: tuple[tuple[str, bytes], ...]):
        self.languages = [name for name, _ in samples]
        seen = sorted({b for _, text in samples for b in text})
        self.width = len(seen) + 1  # 0 stands for bytes that no language has
        self.symbol = np.zeros(256, np.uint8)
        self.symbol[seen] = np.arange(1, self.width)
        tables, self.roots, base = [], [], 0
        entry = np.int32 if 8 * self.width * sum(1 + len(t) for _, t in samples) < 2**31 else np.int64  # under two states a byte
        for _, text in samples:
            move = suffix_automaton(text)
            t = np.full((len(move), self.width), -1, entry)
            for s, row in enumerate(move):
                for c, n in row.items():
                    t[s, self.symbol[c]] = n
            size = len(move)
            del move
            restart = np.where(t[0] < 0, 0, t[0])  # the byte that failed begins the next phrase
            for c in range(self.width):  # one symbol at a time: the table is large
                column = t[:, c]
                dead = column < 0
                ended = dead * (1 + dead[0])  # a byte that the language lacks is a phrase of its own
                ended[0] = dead[0]  # at the root no phrase has begun
                t[:, c] = (np.where(dead, restart[c], column) + base) * self.width << 2 | ended
            self.roots.append(base * self.width)
            base += size
            tables.append(t)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)

    def phrases(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Phrases by text and language, for normalised bytes. A block counts its finished phrases and one more."""
        n = np.diff(at)
        blocks = -(-n // BLOCK)
        doc = np.repeat(np.arange(len(n)), blocks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = at[:-1][doc] + nth * BLOCK
        size = np.minimum(start + BLOCK, at[1:][doc]) - start
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        symbols, top = self.symbol[data].astype(np.int64), int(size[0]) if len(size) else 0
        alive = len(size) - np.searchsorted(size[::-1], np.arange(top), "right")  # blocks longer than t
        count = np.zeros((len(self.languages), len(size)), np.int32)
        state = np.repeat(np.array(self.roots, np.int64)[:, None], len(size), 1)
        for t in range(top):
            m = alive[t]
            step = self.table.take(state[:, :m] + symbols[start[:m] + t])
            count[:, :m] += step & 3
            state[:, :m] = step >> 2
        out = np.zeros((len(n), len(self.languages)), np.int64)
        np.add.at(out, doc[order], count.T + 1)
        return out


def parser(samples: tuple[tuple[str, bytes], ...]) -> CrossParser:
    return K.kept("languages", samples, lambda: CrossParser(samples))


def fit(labelled: DataFrame, seed: int = 17) -> tuple[tuple[str, bytes], ...]:
    """(language, normalised text) learnt from ``labelled(text, lang)``: rows with text and a language, in hash order, a bounded piece of each, from a place that a hash of the text picks."""
    rows = labelled.select("text", "lang").where("text is not null and lang is not null").withColumn("k", F.xxhash64(F.lit(seed), "text"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    n_languages = counts.count()
    share = min(PER_LANGUAGE, IN_ALL // n_languages) if n_languages else 0
    if not share:
        return ()
    want = -(-4 * share // PER_DOCUMENT)  # rows looked at for each language; short rows give less
    odds = F.least(F.lit(1.0), F.lit(2.0 * want) / F.col("n"))
    begin = (F.pmod(F.xxhash64("text", F.lit(seed)), F.greatest(F.lit(1), F.length("text") - PER_DOCUMENT + 1)) + 1).cast("int")
    slim = rows.select("lang", "k", F.substr("text", begin, F.lit(PER_DOCUMENT)).alias("piece"))
    picked = slim.join(F.broadcast(counts), "lang").where(F.pmod("k", F.lit(1 << 20)) < odds * (1 << 20)).drop("n")  # IN_ALL languages at most
    pieces: dict[str, list[str]] = {}
    for r in picked.distinct().orderBy("lang", "k", "piece").collect():
        pieces.setdefault(r.lang, []).append(r.piece)
    out = []
    for lang in sorted(pieces):
        data = np.frombuffer(" ".join(pieces[lang]).encode(), np.uint8)
        text, _ = normalised(data, np.array([0, len(data)]))
        out.append((lang, text[:share].tobytes()))
    return tuple(out)


def identify(docs: DataFrame, samples: tuple[tuple[str, bytes], ...], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1: by how much the runner-up needs more phrases).

    Whole texts are parsed, in blocks. A text that is null or has no letter, and every text if nothing was learnt, gets
    ``und`` and 0. Ties go to the language first in the alphabet. Repeated rows are equal; columns already called
    ``lang_pred`` or ``score`` are replaced, all others kept. One pass, no shuffle.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(samples)  # bounded by IN_ALL
    has = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    work = docs.drop("lang_pred", "score").withColumn("__letters", has)
    schema = work.drop("__letters").schema.add("lang_pred", "string").add("score", "double")
    keep = schema.fieldNames()[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(shared.value)
        names = np.array([*p.languages, UNDETERMINED], object)
        for rows, data, at in K.chunks(batches, text):
            letters = rows.column(rows.schema.get_field_index("__letters")).to_numpy(zero_copy_only=False)
            pred, score = np.full(len(letters), len(p.languages)), np.zeros(len(letters))
            if p.languages:
                counts = p.phrases(*normalised(data, at))
                best = counts.argmin(1)
                if len(p.languages) > 1:
                    two = np.partition(counts, 1, 1)[:, :2]
                    gap = 1 - two[:, 0] / np.maximum(two[:, 1], 1)
                else:
                    gap = np.ones(len(letters))
                pred, score = np.where(letters, best, pred), np.where(letters, gap, 0.0)
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(c)) for c in keep] + [pa.array(names[pred], pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return work.mapInArrow(run, schema)


def training(docs: DataFrame, held_out: Column) -> DataFrame:
    return docs.where(~held_out).select("text", "lang")
