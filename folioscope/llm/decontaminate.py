"""Benchmark decontamination by greedy string tiling.

The seeds of benchmark items (runs of TILE words, hashed) are joined with those of the documents; a bitmap of fixed size
keeps seeds that no item has from being moved. Of each text and item that share a seed only the places of shared seeds meet.
There the longest match of unmarked words, found by running Karp-Rabin hashes over the seeds, is marked over and over
until none of the least length is left. Tiles may come in any order, so reordered passages are covered too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import kernels as K
from folioscope.operators.components import stored
from folioscope.operators.prefilter import marked
from folioscope.operators.ship import ship

#: Least words of a tile, and least share of an item's words that tiles cover.
TILE, COVERAGE = 5, 0.8
#: Bits of the bitmap of seeds (8 MB): with more seeds than bits more of them are moved, results stay the same.
BITS = 1 << 26


def _free(pos: np.ndarray, value: np.ndarray, used: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.concatenate(([0], np.cumsum(used)))
    keep = n[pos + k] == n[pos]
    return pos[keep], value[keep]


def _runs(pos: np.ndarray) -> np.ndarray:
    """How many seeds follow each other without a gap from each on, itself included."""
    last = np.flatnonzero(np.concatenate((np.diff(pos) != 1, [True])))
    return last[np.searchsorted(last, np.arange(len(pos)))] - np.arange(len(pos)) + 1


def tile(n_words: int, k: int, item: tuple[np.ndarray, np.ndarray], doc: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which of an item's ``n_words`` words greedy tiles of at least ``k`` words cover.

    ``item`` and ``doc`` are the places of their shared seeds, ascending, and which seed stands there. Of the longest
    matches the first in the item comes first, and of these the first in the document. Memory is linear in the places.
    """
    cover, used = np.zeros(n_words, bool), np.zeros(int(doc[0].max(initial=0)) + k, bool)
    while True:
        item, doc = _free(*item, cover, k), _free(*doc, used, k)
        if not len(item[0]) or not len(doc[0]):
            return cover
        sides = []
        for pos, value in (item, doc):
            codes = K.mix(value.astype(np.uint64) + np.uint64(1)) * K.powers(len(pos) + 1)[0][: len(pos)]
            sides.append((np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes))), _runs(pos)))

        def hashed(side: int, r: int, sides=sides) -> tuple[np.ndarray, np.ndarray]:
            prefix, run = sides[side]
            start = np.flatnonzero(run >= r)
            return start, K.range_hash(prefix, start, start + r)

        lo, hi = 0, int(min(sides[0][1].max(), sides[1][1].max()))
        while lo < hi:  # the most seeds in a row that both have
            r = (lo + hi + 1) // 2
            lo, hi = (r, hi) if np.isin(hashed(0, r)[1], hashed(1, r)[1]).any() else (lo, r - 1)
        if not lo:
            return cover
        (a, ha), (b, hb) = hashed(0, lo), hashed(1, lo)
        order = np.argsort(hb, kind="stable")
        b, hb, size = doc[0][b[order]], hb[order], lo + k - 1
        at = {}  # where to go on among the places of one hash: those before are taken
        for x, h in zip(item[0][a].tolist(), ha.tolist(), strict=True):
            if cover[x : x + size].any():
                continue
            first, last = at[h] if h in at else (int(np.searchsorted(hb, np.uint64(h), "left")), int(np.searchsorted(hb, np.uint64(h), "right")))
            while first < last and used[b[first] : b[first] + size].any():
                first += 1
            at[h] = first, last
            if first < last:
                cover[x : x + size] = True
                used[b[first] : b[first] + size] = True


def _places(seed: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Distinct seeds, and the places of each."""
    order = np.argsort(seed, kind="stable")
    s = seed[order]
    cut = np.flatnonzero(np.concatenate(([True], np.diff(s) != 0))) if len(s) else np.zeros(0, np.int64)
    return s[cut], pa.ListArray.from_arrays(pa.array(np.concatenate((cut, [len(s)])).astype(np.int32)), pa.array(order.astype(np.int32)))


def _seeds(h: np.ndarray, k: int) -> np.ndarray:
    return K.grams(h, np.array([0, len(h)]), k)[0] ^ np.uint64(k)


def item_seeds(benchmark: DataFrame, k: int) -> DataFrame:
    """``item, item_id, k, n_words, seed, item_at``: each item's distinct seeds with their places; an item shorter than k words is one seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in K.chunks(batches):
            h, first = K.words(data, at, K.MARKS)
            for i in range(rows.num_rows):
                mine = h[first[i] : first[i + 1]]
                size = min(k, len(mine))
                if size:
                    seed, places = _places(_seeds(mine, size))
                    n, one = len(seed), rows.slice(i, 1)
                    same = [pa.array([one.column(c)[0].as_py()] * n, pa.int64()) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(np.full(n, size, np.int32)), pa.array(np.full(n, len(mine), np.int32)), K.long_column(seed), places], names=["item", "item_id", "k", "n_words", "seed", "item_at"])

    items = benchmark.where("text is not null").select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropDuplicates(["item", "item_id"])
    return items.mapInArrow(run, "item long, item_id long, k int, n_words int, seed long, item_at array<int>")


def _bitmap(seeds: DataFrame) -> bytes:
    """BITS bits, those of the seeds set."""
    slot = F.pmod("seed", F.lit(BITS)) + 1
    maps = seeds.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    out = bytearray(BITS // 8)
    for r in maps.toLocalIterator():  # BITS / 32768 rows of 4 kB at most
        out[(r.b - 1) * 4096 : r.b * 4096] = r.m
    return bytes(out)


def met_seeds(texts: DataFrame, sizes: list[int], bitmap) -> DataFrame:
    """``t1, t2, seed, at``: of each text the distinct seeds that the bitmap holds, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for rows, data, at in K.chunks(batches):
            h, first = K.words(data, at, K.MARKS)
            for k in sizes:
                g, begin = K.grams(h, first, k)
                g = g ^ np.uint64(k)
                slot = (g & np.uint64(BITS - 1)).astype(np.int64)
                hit = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                text = np.searchsorted(begin, hit, "right") - 1
                cut = np.flatnonzero(np.diff(text)) + 1
                for part in np.split(hit, cut) if len(hit) else ():
                    i = int(np.searchsorted(begin, part[0], "right")) - 1
                    seed, places = _places(g[part])
                    places = pa.ListArray.from_arrays(places.offsets, pa.array((part - begin[i])[places.values.to_numpy()].astype(np.int32)))
                    same = [pa.array(np.full(len(seed), rows.column(c)[i].as_py(), np.int64)) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*same, K.long_column(seed), places], names=["t1", "t2", "seed", "at"])

    return texts.mapInArrow(run, "t1 long, t2 long, seed long, at array<int>")


def _sequence(places: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(places.offsets.to_numpy())
    pos, which = places.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
    order = np.argsort(pos, kind="stable")
    return pos[order].astype(np.int64), which[order]


def covered(pairs: DataFrame) -> DataFrame:
    """``t1, t2, item_id, share``: the share of the item's words that tiles cover in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, n, share = b.column(3).to_pylist(), b.column(4).to_pylist(), []
            for i in range(b.num_rows):
                met = b.column(5)[i].values
                share.append(float(tile(n[i], k[i], _sequence(met.field("item_at")), _sequence(met.field("at"))).mean()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(3)), pa.array(share, pa.float64())], names=["t1", "t2", "item_id", "share"])

    return pairs.select("t1", "t2", "item_id", "k", "n_words", "met").mapInArrow(run, "t1 long, t2 long, item_id long, share double")


NEW = ("n_items", "best_item", "best_coverage", "contaminated")


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = TILE, coverage: float = COVERAGE, text: str = "text") -> DataFrame:
    """``docs`` with ``n_items`` (items that share a tile), ``best_item``, ``best_coverage`` and ``contaminated`` (coverage reached).

    Words are runs of ASCII letters and digits and of other than ASCII characters, A-Z lower-cased, so punctuation and
    layout do not hide a passage. An item of fewer than ``k`` words must be met whole; items without words or text match
    nothing, items that repeat an id and text are one. Null and empty texts are clean, long ones are compared whole. Ties
    go to the smallest item id. Repeated rows get equal results, and equal texts are compared once; columns of the same
    names are replaced, others kept whatever they are called.

    Plan: seeds that the bitmap lets through, of texts and items, are joined by hash; only texts that meet an item are
    moved to take up their result. Nothing that grows with documents or benchmark passes through the driver or is sent
    to all executors, but where Spark finds the stored seeds of the benchmark below its broadcast threshold.
    """
    spark = docs.sparkSession
    ship(spark)
    seeds = stored(item_seeds(benchmark, k), "seeds")
    sizes = sorted(r.k for r in seeds.select("k").distinct().collect())  # k numbers at most
    bitmap = spark.sparkContext.broadcast(_bitmap(seeds))
    work = docs.drop(*NEW)
    kept = work.columns
    body = F.col(text).cast("string")
    work = work.withColumn("__t1", F.xxhash64(body)).withColumn("__t2", F.xxhash64(F.lit(1), body))
    texts = work.where(F.col(text).isNotNull()).select(F.col("__t1").alias("t1"), F.col("__t2").alias("t2"), body.alias("text"))
    met = met_seeds(texts, sizes, bitmap).join(seeds, "seed").dropDuplicates(["t1", "t2", "item", "item_id", "seed"])
    pairs = met.groupBy("t1", "t2", "item", "item_id").agg(F.first("k").alias("k"), F.first("n_words").alias("n_words"), F.collect_list(F.struct("item_at", "at")).alias("met"))
    share = covered(pairs).where("share > 0")
    best = F.max_by(F.struct("item_id", "share"), F.struct("share", -F.col("item_id")))
    found = share.groupBy("t1", "t2").agg(F.count("*").cast("int").alias("n"), best.alias("x"))
    found = stored(found.select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), F.col("n").alias("__n"), F.col("x.item_id").alias("__item"), F.col("x.share").alias("__share")), "contaminated")
    both = marked(work, F.col("__t1"), found, F.col("__t1"), "__maybe")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("__n", "int"), ("__item", "long"), ("__share", "double"))]
    out = both.where("__maybe").join(found, ["__t1", "__t2"], "left").select(*kept, "__n", "__item", "__share").union(both.where("not __maybe").select(*kept, *none))
    share = F.coalesce("__share", F.lit(0.0))
    return out.select(*kept, F.coalesce("__n", F.lit(0)).alias("n_items"), F.col("__item").alias("best_item"), share.alias("best_coverage"), (share >= coverage).alias("contaminated"))
