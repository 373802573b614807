"""Near-duplicate documents by min-max hashing.

Both the smallest and the largest shingle hash under each permutation are kept, so a signature of 2m values costs m
evaluations. Bands of the signature make buckets. Documents with equal shingle sets are one node; in each bucket all
nodes are compared with one centre, then, where a bucket still holds several components, with its best-linked node, and
at last across components where they share a rare shingle, so that neither groups of copies nor texts around one common
passage become all their pairs, while no link between components that share a bucket is missed. Every link is
confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import kernels as K
from folioscope.operators.components import connected_components, stored
from folioscope.operators.prefilter import probably_in
from folioscope.operators.ship import ship

#: 40 permutations give 80 values, 20 bands of 4: two documents of similarity 0.85 share no bucket once in 2.5 million.
PERMUTATIONS, ROWS = 40, 4
#: Open nodes around one shingle that one task compares with the others around it.
PART = 256


def shingles(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text's begin. Fewer than k words make one shingle."""
    h, first = K.words(data, at)
    g, begin = K.grams(h, first, k)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < k))
    parts, sizes = [], np.zeros(len(at) - 1, np.int64)
    lone = {}
    for d in short.tolist():
        n = first[d + 1] - first[d]
        lone[d] = K.grams(h[first[d] : first[d + 1]], np.array([0, n]), int(n))[0] ^ np.uint64(n)
    for d in range(len(at) - 1):
        s = lone[d] if d in lone else np.unique(g[begin[d] : begin[d + 1]])
        parts.append(s)
        sizes[d] = len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def signatures(docs: DataFrame, k: int, permutations: int = PERMUTATIONS, rows: int = ROWS, text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, lo, hi, bands``: size and 128-bit hash of each document's shingle set, and its band keys (none for an empty set)."""
    ship(docs.sparkSession)
    permutations = -(-permutations // rows) * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, data, at in K.chunks(batches, text):
            s, begin = shingles(data, at, k)
            full = np.flatnonzero(np.diff(begin))
            start, n = begin[:-1][full], len(begin) - 1
            lo, hi = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            sig = np.zeros((len(full), 2 * permutations), np.uint64)
            if len(full):
                lo[full] = np.add.reduceat(K.mix(s), start)
                hi[full] = np.add.reduceat(K.mix(s ^ K.FAMILY_X[255]), start)
                for p in range(permutations):
                    x = (s ^ K.FAMILY_X[p]) * K.FAMILY_A[p]
                    sig[:, p] = np.minimum.reduceat(x, start)
                    sig[:, permutations + p] = np.maximum.reduceat(x, start)
            bands = np.zeros((len(full), 2 * permutations // rows), np.uint64)
            for r in range(rows):
                bands = K.mix(bands * np.uint64(31) + sig[:, r::rows])
            bands = K.mix(bands + np.arange(bands.shape[1], dtype=np.uint64))
            count = np.zeros(n, np.int32)
            count[full] = bands.shape[1]
            at_band = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [chunk.column(0), pa.array(np.diff(begin)), K.long_column(lo), K.long_column(hi), pa.ListArray.from_arrays(pa.array(at_band), K.long_column(bands.ravel()))],
                names=["doc_id", "n_shingles", "lo", "hi", "bands"],
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias(text))
    return plain.mapInArrow(run, "doc_id long, n_shingles long, lo long, hi long, bands array<long>")


def shingle_sets(docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """``doc_id, lo, hi, shingles``: the full sets."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, data, at in K.chunks(batches, text):
            s, begin = shingles(data, at, k)
            full, n = np.flatnonzero(np.diff(begin)), len(begin) - 1
            lo, hi = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            if len(full):
                lo[full] = np.add.reduceat(K.mix(s), begin[:-1][full])
                hi[full] = np.add.reduceat(K.mix(s ^ K.FAMILY_X[255]), begin[:-1][full])
            yield pa.RecordBatch.from_arrays([chunk.column(0), K.long_column(lo), K.long_column(hi), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), K.long_column(s))], names=["doc_id", "lo", "hi", "shingles"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias(text))
    return plain.mapInArrow(run, "doc_id long, lo long, hi long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs(a, b)`` whose full sets reach the threshold."""
    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    whole = pairs.join(left, "a").join(right, "b")
    return whole.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _to_hub(open_: DataFrame, links: DataFrame) -> DataFrame:
    """Members of each bucket with the best-linked member of another component."""
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    ranked = open_.join(degree, "node", "left").withColumn("rank", F.struct(F.coalesce("degree", F.lit(0)), -F.col("node")))
    hub = ranked.groupBy("bucket").agg(F.max_by(F.struct(F.col("node").alias("centre"), F.col("n").alias("n_centre"), F.col("component_id").alias("c")), "rank").alias("x"))
    return open_.join(hub.select("bucket", "x.*"), "bucket").where("component_id <> c")


def _across(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Nodes with those of other components that a rare shingle joins: what no centre has linked.

    Shingles are ordered by how few of the open nodes have them. Two sets of n and m that reach the threshold share at
    least o = ceil(percent * (n + m) / (100 + percent)) shingles, so the first they share is among the first n - o + 1 of
    one and m - o + 1 of the other; passages that thousands of otherwise different texts share come later than that.
    """
    nodes = open_.select("node", "n", "component_id").distinct()
    each = nodes.join(sets, "node").select("node", F.explode("shingles").alias("s"))
    rare = each.join(each.groupBy("s").agg(F.count("*").alias("df")), "s").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("x"))
    length = F.expr(f"cast(n - (n * {percent} + 99) div 100 + 1 as int)")
    prefix = nodes.join(rare, "node").select("node", "n", "component_id", F.posexplode(F.slice("x", F.lit(1), length)).alias("i", "x"))
    prefix = stored(prefix.where("x.df > 1").select("node", "n", "component_id", "i", "x.s"), "prefixes")
    parts = F.ceil(F.count("*") / PART)
    mixed = prefix.groupBy("s").agg(F.min("component_id").alias("x"), F.max("component_id").alias("y"), parts.alias("parts")).where("x < y").select("s", "parts")
    met = stored(prefix.join(mixed, "s"), "met")
    # a shingle that many open nodes have is dealt by node into parts of a fixed size, each of which meets all the others
    one = met.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).drop("parts")
    other = met.select("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("node").alias("centre"), F.col("n").alias("n_centre"), F.col("component_id").alias("c"), F.col("i").alias("j"))
    least = f"(({percent} * (n + n_centre) + {99 + percent}) div {100 + percent})"
    return one.join(other, ["s", "part"]).where(f"component_id < c and i + {least} <= n and j + {least} <= n_centre")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    Texts are linked if 100 * |A & B| >= percent * |A | B| over their sets of distinct k-word shingles (A-Z lower-cased);
    with fewer than k words the whole sequence is one shingle; without words, or null, the set is empty and linked with
    nothing. ``component_id`` is the smallest doc_id reachable by links, the own one included; ``kept`` marks it. Rows
    that repeat a doc_id are one node, linked by any of their texts. A null doc_id is linked with nothing, has no
    component and is kept. Columns other than doc_id and the text are not read. Very long texts are read whole, shingle by
    shingle; their sets are compared whole. An empty table gives no rows.
    """
    rows = stored(signatures(docs, k, text=text), "signatures")
    named = rows.where("doc_id is not null and n_shingles > 0")
    # a node stands for all documents with the same set
    nodes = stored(named.groupBy("lo", "hi").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.min_by("bands", "doc_id").alias("bands")), "nodes")
    member = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("other"), F.min_by("n", "node").alias("n_centre")).where("centre < other").drop("other")
    buckets = stored(member.join(shared, "bucket"), "buckets")
    fits = F.expr(f"100 * least(n, n_centre) >= {percent} * greatest(n, n_centre)")
    compared = stored(buckets.where("node <> centre").where(fits).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), "pairs")
    wanted = buckets.select(F.col("node").alias("doc_id")).distinct()
    texts = probably_in(docs.select("doc_id", text), F.col("doc_id"), wanted, F.col("doc_id"))
    exact = nodes.select("node", "lo", "hi").join(wanted.withColumnRenamed("doc_id", "node"), "node", "left_semi")
    sets = shingle_sets(texts, k, text).withColumnRenamed("doc_id", "node").join(exact, ["node", "lo", "hi"]).dropDuplicates(["node", "lo", "hi"])
    sets = stored(sets.select("node", "shingles"), "sets")
    links = stored(_confirmed(compared, sets, percent), "links")
    # rows of one doc_id with several sets tie these together
    ties = named.join(nodes.select("lo", "hi", "node"), ["lo", "hi"]).groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.collect_set("node").alias("all"))
    ties = ties.where("a < b").select("a", F.explode("all").alias("b")).where("a < b").select("a", "b")
    links = stored(links.union(ties), "links")
    found = connected_components(links)
    for joined in (_to_hub, _across):
        at = buckets.select("bucket", "node", "n").join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component_id", F.coalesce("component_id", "node"))
        split = at.groupBy("bucket").agg(F.min("component_id").alias("x"), F.max("component_id").alias("y"), F.count("*").alias("m")).where("x < y and m > 2").select("bucket")
        open_ = stored(at.join(split, "bucket"), "open")
        pairs = joined(open_, links) if joined is _to_hub else joined(open_, sets, percent)
        pairs = pairs.where(fits).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        pairs = stored(pairs.join(compared, ["a", "b"], "left_anti"), "pairs")
        new = stored(_confirmed(pairs, sets, percent), "links")
        if not new.isEmpty():
            links, compared = links.union(new), compared.union(pairs)
            found = connected_components(links)
    comp = nodes.join(found.withColumnRenamed("id", "node"), "node", "left").select("lo", "hi", F.coalesce("component_id", "node").alias("component_id"))
    out = rows.join(comp, ["lo", "hi"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
