"""Language-model scoring with a log-frequency Bloom filter.

Bigram counts of the whole training text are quantised to powers of two; a bigram counted c times stands in the filter
1 + floor(log2 c) times, once for each level up to its own, so repeated membership probes read its level back. The
filter takes BITS bits an entry whatever the input: it lies in segments by hash, which the bigrams of each block of
documents meet in one shuffle. Word counts are exact and come to the documents block by block, and with them what the
levels of all bigrams after a word add up to, so that the probabilities of what follows a word sum to one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm import kernels as K
from folioscope.operators.ship import ship

#: Bits for each entry, and probes of each: one reading in 100,000 of a bigram that is not there is false.
BITS, PROBES = 24.0, 16
#: What each bigram after a word gives up to the word distribution (absolute discounting).
DISCOUNT = 0.75
#: Bytes of text in a block of documents and in a segment of bigrams or words.
BLOCK, SEGMENT = 16 << 20, 8 << 20
GATHER = 2_000_000  # tokens whose different words a task gathers at a time
END, BEGIN = (K.mix(np.array([x], np.uint64))[0] for x in (0xE0D, 0xB06))
LOW = np.uint64((1 << 40) - 1)
#: The count that a level stands for: none, one, then about the middle of the counts from 2**k to 2**(k + 1).
COUNT_OF = np.array([0, 1, *(round(1.4 * 2.0**k) for k in range(1, 56))], np.int64)


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes, each text closed by END, and where each text begins."""
    h, first = K.words(data, at)
    n = len(first) - 1
    return np.insert(h, first[1:], END), first + np.arange(n + 1)


def contexts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The token before each token; BEGIN stands before a text."""
    before = np.concatenate(([BEGIN], h[:-1]))
    before[first[:-1]] = BEGIN
    return before


def bigrams(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it."""
    return K.mix(before * np.uint64(0xD6E8FEB86659FD93) + h)


def _read(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a block, the token before each, and the number of tokens of each text."""
    parts = []
    for _, data, at in K.chunks(table.to_batches()):
        h, first = tokens(data, at)
        parts.append((h, contexts(h, first), np.diff(first)))
    h, before, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, before, n


def _planes(x: np.ndarray, kind: str = "<i8") -> bytes:
    """Integers with the first bytes of all of them first: high bytes are mostly zero, so a shuffle packs them away."""
    x = np.ascontiguousarray(x.astype(kind))
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(data: bytes, kind: str = "<i8") -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel().astype(np.int64)


def _spans(h: np.ndarray, bits: int) -> tuple[np.ndarray, list[slice]]:
    """Segments (the first ``bits`` bits) of sorted hashes, and where each stands."""
    seg = (h >> np.uint64(64 - bits)).astype(np.int64)
    cut = [0, *(np.flatnonzero(np.diff(seg)) + 1).tolist(), len(h)]
    return seg[cut[:-1]], [slice(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _doubled(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where an entry's probes begin, and the step from one to the next (double hashing)."""
    a = K.mix((h & LOW) + np.uint64(level << 48))
    return a, K.mix(a) | np.uint64(1)


def segment_of(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bits of the filter segment of distinct bigrams counted ``n`` times; BITS for each entry."""
    h, n = h[n > 0], n[n > 0]
    level = np.floor(np.log2(n)).astype(np.int64)
    flags = np.zeros(max(4096, int((level + 1).sum() * BITS)) | 1, bool)
    for q in range(int(level.max(initial=-1)) + 1):
        a, b = _doubled(h[level >= q], q)
        for _ in range(PROBES):
            flags[a % np.uint64(len(flags))] = True
            a = a + b
    return flags


def levels_of(flags: np.ndarray, h: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c) of each bigram hash, 0 for one that is not in the filter: probed level by level until one is missing."""
    out, live, level = np.zeros(len(h), np.uint8), np.arange(len(h)), 0
    while len(live):
        a, b = _doubled(h[live], level)
        for _ in range(PROBES):
            hit = flags[a % np.uint64(len(flags))]
            live, a, b = live[hit], a[hit], b[hit]
            a = a + b
        level += 1
        out[live] = level
    return out


def _vocabulary_size(train: DataFrame, bits: int) -> tuple[int, int]:
    """Tokens of ``train(text)`` and distinct ones, exactly: each task's different words meet those of others segment by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def batch() -> pa.RecordBatch:
            w = np.unique(np.concatenate(held))
            seg, spans = _spans(w, bits)
            total = np.zeros(len(seg), np.int64)
            total[:1] = n
            return pa.RecordBatch.from_arrays([pa.array(seg), pa.array([w[s].tobytes() for s in spans], pa.binary()), pa.array(total)], names=["segment", "w", "n"])

        for _, data, at in K.chunks(batches):
            h, _ = tokens(data, at)
            held.append(np.unique(h))
            n += len(h)
            if n >= GATHER:
                yield batch()
                held, n = [], 0
        if n:
            yield batch()

    def count(t: pa.Table) -> pa.Table:
        w = np.unique(np.frombuffer(b"".join(t.column("w").to_pylist()), np.uint64))
        return pa.table({"types": pa.array([len(w)]), "n": pa.array([pc.sum(t.column("n")).as_py()])})

    found = train.mapInArrow(run, "segment long, w binary, n long").groupBy("segment").applyInArrow(count, "types long, n long")
    r = found.agg(F.sum("types").alias("v"), F.sum("n").alias("n")).first()
    return r.n or 0, r.v or 0


NEW = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def score(docs: DataFrame, held_out: Column, text: str = "text", discount: float = DISCOUNT) -> DataFrame:
    """``docs`` without its text, with ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Whole texts are tokenised: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, then one end token. Documents for which
    ``held_out`` is false or null are learnt from. ``base_score`` sums log10((c + 0.1) / (N + 0.1 * (V + 1))) over tokens
    by exact counts (words are told apart by 64-bit hashes). ``score`` is log10 of the probability of the text by
    bigrams: with q the count that the level of a bigram stands for, Q and T the sum of q and the number of bigrams after
    the word before, a token has (max(q - d, 0) + d * T * base) / Q, or base where nothing was seen to follow; so the
    probabilities of all known tokens and of the unknown one sum to 1 after every word, but for false readings.
    A null text is empty: one token, the end. Repeated rows count as often as they stand there and get equal scores.
    Nothing to learn from gives c = N = V = 0 and a score equal to the base. Columns of the same names are replaced, all
    others but the text kept, whatever they are called.

    Plan: one scan counts tokens and different words; documents are dealt into blocks by a hash of the row. A block's
    distinct bigrams meet those of others once, packed by segment: each segment of the filter is built and read in one
    task, of about SEGMENT bytes of text whatever the input, and the levels go back in the order of the hashes. So do
    its distinct words, one packed row for each block and segment, which come back with their totals.
    """
    spark = docs.sparkSession
    ship(spark)
    rest = [c for c in docs.columns if c not in (*NEW, text)]
    own = F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])
    body = F.col(text).cast("string")
    n_bytes = docs.agg(F.sum(F.octet_length(body))).first()[0] or 0
    bits = max(4, math.ceil(math.log2(max(1, n_bytes / SEGMENT))))
    n_blocks = max(1, -(-n_bytes // BLOCK))
    key = [F.col(c) for c in ("doc_id",) if c in docs.columns]
    blocks = docs.select(own.alias("own"), F.coalesce(held_out, F.lit(False)).alias("held"), body.alias("text"), F.pmod(F.xxhash64(*key, body), F.lit(n_blocks)).alias("block"))
    total, types = _vocabulary_size(blocks.where("not held").select("text"), bits)
    norm = total + 0.1 * (types + 1)

    def trains(table: pa.Table, n: np.ndarray) -> np.ndarray:
        return np.repeat(~table.column("held").to_numpy(zero_copy_only=False), n)

    def pairs(table: pa.Table) -> pa.Table:
        h, before, size = _read(table)
        h, inverse = np.unique(bigrams(h, before), return_inverse=True)
        n = np.bincount(inverse, trains(table, size), minlength=len(h))
        seg, spans = _spans(h, bits)
        low, high = (h & np.uint64(0xFFFFFFFF)).astype("<u4"), ((h & LOW) >> np.uint64(32)).astype(np.uint8)
        cols = ([x[s].tobytes() for s in spans] for x in (low, high))
        counts = [_planes(n[s], "<u4") for s in spans]
        return pa.table({"block": np.full(len(seg), table.column("block")[0].as_py(), np.int64), "segment": seg, **{k: pa.array(c, pa.binary()) for k, c in zip(("low", "high", "n"), (*cols, counts), strict=True)}})

    def filtered(table: pa.Table) -> pa.Table:
        """Levels of each row's bigrams; the first row that has a bigram is told so by the highest bit."""
        low, high = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("low", "<u4"), ("high", np.uint8)))
        n = np.concatenate([_unplanes(x, "<u4") for x in table.column("n").to_pylist()])
        h, lead, where = np.unique(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), return_index=True, return_inverse=True)
        level = levels_of(segment_of(h, np.bincount(where, n, minlength=len(h))), h)[where]
        level[lead] |= 0x80
        cut = np.cumsum([0, *(len(x) for x in table.column("high").to_pylist())])
        out = pa.array([level[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
        return pa.table({"block": table.column("block"), "segment": table.column("segment"), "levels": out})

    def in_order(table: pa.Table, column: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(table.sort_by("segment").column(column).to_pylist()), kind)

    def vocabulary(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each different word of the block: its uses in training, and what the bigrams after it that the block leads with add up to."""
        h, before, size = _read(left)
        mask = trains(left, size)
        _, one = np.unique(bigrams(h, before), return_index=True)
        level = in_order(right, "levels", np.uint8)
        mine = (level > 0x80).nonzero()[0]  # those read as not there count for nothing
        w, inverse = np.unique(np.concatenate((h, [BEGIN])), return_inverse=True)
        n = np.bincount(inverse[:-1], mask, minlength=len(w))
        at = np.searchsorted(w, before[one[mine]])
        sums = np.bincount(at, COUNT_OF[level[mine] & 0x7F], minlength=len(w)), np.bincount(at, minlength=len(w))
        seg, spans = _spans(w, bits)
        cols = {"w": [w[s].tobytes() for s in spans], **{k: [_planes(x[s]) for s in spans] for k, x in zip("nqt", (n, *sums), strict=True)}}
        return pa.table({"block": np.full(len(seg), left.column("block")[0].as_py(), np.int64), "segment": seg, **{k: pa.array(c, pa.binary()) for k, c in cols.items()}})

    def totals(table: pa.Table) -> pa.Table:
        pieces = table.column("w").to_pylist()
        w, where = np.unique(np.frombuffer(b"".join(pieces), np.uint64), return_inverse=True)
        cut = np.cumsum([0, *(len(x) // 8 for x in pieces)])
        cols = {}
        for k in "nqt":
            x = np.concatenate([_unplanes(p) for p in table.column(k).to_pylist()])
            all_of = np.bincount(where, x, minlength=len(w)).astype(np.int64)[where]
            cols[k] = pa.array([_planes(all_of[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
        return pa.table({"block": table.column("block"), "segment": table.column("segment"), **cols})

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        level_rows = pc.is_valid(right.column("levels"))
        levels, known = right.filter(level_rows), right.filter(pc.invert(level_rows)).sort_by("segment")
        n_of, q_of, t_of = (np.concatenate([_unplanes(p) for p in known.column(k).to_pylist()]).astype(np.float64) for k in "nqt")
        h, before, size = _read(left)
        q = COUNT_OF[(in_order(levels, "levels", np.uint8) & 0x7F)[np.unique(bigrams(h, before), return_inverse=True)[1]]]
        w = np.unique(np.concatenate((h, [BEGIN])))
        n, at = n_of[np.searchsorted(w, h)], np.searchsorted(w, before)
        base = (n + 0.1) / norm
        followed = np.maximum(q_of[at], 1)
        p = np.where(q_of[at] > 0, (np.maximum(q - discount, 0) + discount * t_of[at] * base) / followed, base)
        first = np.cumsum(size) - size
        sums = {"n_known": np.add.reduceat((n > 0).astype(np.int64), first), "base_score": np.add.reduceat(np.log10(base), first), "score": np.add.reduceat(np.log10(p), first)}
        return pa.table({"own": left.column("own"), "held": left.column("held"), "n_tokens": size, **sums})

    packed = blocks.groupBy("block").applyInArrow(pairs, "block long, segment long, low binary, high binary, n binary")
    levels = packed.groupBy("segment").applyInArrow(filtered, "block long, segment long, levels binary")
    words = blocks.groupBy("block").cogroup(levels.groupBy("block")).applyInArrow(vocabulary, "block long, segment long, w binary, n binary, q binary, t binary")
    known = words.groupBy("segment").applyInArrow(totals, "block long, segment long, n binary, q binary, t binary")
    back = known.unionByName(levels, allowMissingColumns=True)
    schema = blocks.select("own", "held").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)
    rows = blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(judge, schema)
    kept = [F.col(f"own.c{i}").alias(c) for i, c in enumerate(rest)]
    return rows.select(*kept, F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
