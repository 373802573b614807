"""Near-duplicate embeddings by NN-descent.

Neighbour lists begin in the leaves of random hyperplane trees and are refined by joining neighbours of neighbours: the
members of each vector's neighbourhood, in both directions, are compared with each other and every list keeps its best.
A list that is full of links is saturated: there may be more, so it is enlarged GROW times and refined again, up to WIDEST. Vectors
with more links than that lie in groups whose pairs are not to be listed: these are compared with all vectors of their
label block by block, which counts their links. Recall is audited against brute force on ``AUDIT`` sampled vectors, whatever the
size of the table; below the target, more trees are grown and the lists refined again, and what is still missed is warned of.
Vectors that are equal number for number are one node throughout.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.components import connected_components, stored
from folioscope.operators.ship import ship

log = logging.getLogger(__name__)
#: Length of a list, least number of trees, vectors in a leaf, odds that a link shares no leaf of any tree, and the share of links below which a round's gain ends the refinement.
LIST, TREES, LEAF, MISS, GAIN = 10, 8, 32, 0.0025, 0.001
#: Vectors audited, the recall to reach, how often more trees are grown to reach it, and vectors in a block of the search that compares all.
AUDIT, RECALL, AGAIN, BLOCK = 200, 0.95, 3, 8192
#: How many times longer saturated lists become at a time, up to which length, and parts in which a label's rows take up its size.
GROW, WIDEST, SALTS = 4, 40, 32
SLACK = 1e-4  # single precision may misplace a similarity by so much; links are confirmed in double


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def nodes(vectors: DataFrame) -> DataFrame:
    """``node, space, copies, first_id, unit``: distinct usable vectors; a space is a label and a dimension."""
    usable = "vec_id is not null and label is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.where(usable).select("vec_id", F.concat_ws("/", F.size("embedding").cast("string"), "label").alias("space"), "embedding")
    top = F.array_max(F.transform("embedding", F.abs))
    v = v.select("vec_id", "space", F.xxhash64("space", "embedding").alias("node"), F.transform("embedding", lambda x: x / top).alias("scaled"))
    v = v.groupBy("node", "space").agg(F.count_distinct("vec_id").alias("copies"), F.min("vec_id").alias("first_id"), F.first("scaled").alias("scaled"))
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x))
    return v.withColumn("norm", norm).select("node", "space", "copies", "first_id", F.transform("scaled", lambda x: x / F.col("norm")).alias("unit"))


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """``a, b, sim`` with the k best of each a."""
    one = pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    lists = one.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "b")), False), 1, k).alias("x"))
    return lists.select("a", F.explode("x").alias("x")).select("a", "x.b", "x.sim")


def _compared(key: np.ndarray, node: np.ndarray, x: np.ndarray, floor: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Within each run of equal keys, each node's ``most`` best others above its floor."""
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.diff(key[order])) + 1
    for part in np.split(order, cut):
        if len(part) < 2:
            continue
        ids, m = node[part], x[part]
        s = m @ m.T
        s[ids[:, None] == ids[None, :]] = -2
        k = min(most, len(part) - 1)
        j = np.argpartition(-s, k - 1, 1)[:, :k]
        sim = np.take_along_axis(s, j, 1)
        i = np.repeat(np.arange(len(part)), k)
        j, sim = j.ravel(), sim.ravel()
        keep = sim > floor[part][i]
        if keep.any():
            yield ids[i[keep]], ids[j[keep]], sim[keep]


def _joined(table: pa.Table, most: int) -> pa.Table:
    get = lambda c: table.column(c).to_numpy()
    key, node, floor = get("key"), get("node"), get("floor")
    units, size = table.column("unit").combine_chunks(), None
    dims = np.diff(units.offsets.to_numpy())
    out = []
    for size in np.unique(dims):  # groups of one key have one dimension
        at = np.flatnonzero(dims == size)
        x = _matrix(units.take(pa.array(at))).astype(np.float32)
        out += _compared(key[at], node[at], x, floor[at], most)
    a, b, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sim": pa.array(s.astype(np.float64))})


def _join(groups: DataFrame, n: int, most: int) -> DataFrame:
    """``groups(key, node, floor, unit)``: members of each key compared, many keys to a task."""
    bins = F.pmod(F.xxhash64("key"), F.lit(max(1, n // 20_000)))
    return groups.withColumn("bin", bins).groupBy("bin").applyInArrow(lambda t: _joined(t, most), "a long, b long, sim double")


def n_trees(bits: int, threshold: float) -> int:
    """Trees of ``bits`` planes in which vectors at the threshold share no leaf with odds of MISS; no more than it takes to meet all of a space."""
    share = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    most = max(TREES, 1 << bits)
    return TREES if share >= 1 else most if share <= 0 else min(most, max(TREES, math.ceil(math.log(MISS) / math.log1p(-share))))


def _trees(v: DataFrame, n: int, threshold: float, seed: int) -> DataFrame:
    """Pairs of near vectors from the leaves of hyperplane trees, the more the deeper they are; a leaf that holds far too many is dealt into parts."""
    sized = _sized(v, v.groupBy("space").agg(F.count("*").alias("m"))).select("node", "space", "unit", F.greatest(F.lit(0), F.ceil(F.log2(F.col("m") / LEAF))).cast("int").alias("bits"))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = b.column(2)
            dims, bits = np.diff(units.offsets.to_numpy()), b.column(3).to_numpy()
            trees = np.array([n_trees(int(k), threshold) for k in range(41)])[np.minimum(bits, 40)]
            for size in np.unique(dims):
                own = np.flatnonzero(dims == size)
                x = _matrix(units.take(pa.array(own)))
                for t in range(int(trees[own].max())):
                    has = t < trees[own]
                    at = own[has]
                    planes = np.random.Generator(np.random.PCG64([seed, t, int(size)])).standard_normal((int(size), 40))
                    side = (x[has] @ planes > 0).astype(np.int64)
                    mask = np.arange(40)[None, :] < bits[at][:, None]
                    code = (side * mask) @ (1 << np.arange(40))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(np.full(len(at), t, np.int64)), pa.array(code)], names=["node", "space", "tree", "code"])

    leaf = sized.mapInArrow(codes, "node long, space string, tree long, code long").withColumn("leaf", F.xxhash64("space", "tree", "code"))
    trees = n_trees(max(0, math.ceil(math.log2(max(1, n) / LEAF))), threshold)  # at most
    full = leaf.groupBy("leaf").agg(F.count("*").alias("m"))
    dealt = leaf.join(full, "leaf").select("node", F.xxhash64("leaf", F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("m") / (2.0 * LEAF)))).alias("key"), F.lit(-2.0).alias("floor"))
    return _join(dealt.join(v.select("node", "unit"), "node"), n * trees, LIST // 2)


def _sized(v: DataFrame, sizes: DataFrame) -> DataFrame:
    """``v`` with the columns of ``sizes(space, ...)``, which go to every part of a space, so that a large one is no single task's."""
    parts = sizes.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return v.withColumn("__salt", F.pmod(F.xxhash64("node", F.lit(9)), F.lit(SALTS)).cast("int")).join(parts, ["space", "__salt"]).drop("__salt")


def _refined(lists: DataFrame, v: DataFrame, n: int, round_: int, size: int = LIST, full: DataFrame | None = None) -> DataFrame:
    """One step of NN-descent: candidates from neighbours of neighbours. Members of crowded neighbourhoods are sampled, both ways, by a hash.

    With ``full``, only those nodes' lists are refined, up to ``size``."""
    both = lists.select("a", "b").union(lists.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    crowd = both.groupBy("a").agg(F.count("*").alias("m"))
    both = both.join(crowd, "a").join(crowd.withColumnRenamed("a", "b").withColumnRenamed("m", "m2"), "b")
    draw = F.pmod(F.xxhash64("a", "b", F.lit(round_)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    both = both.where(draw * F.greatest("m", "m2") < 2.0 * size).select(F.col("a").alias("key"), F.col("b").alias("node"))
    both = both.union(v.select(F.col("node").alias("key"), "node"))
    if full is None:
        floor = lists.groupBy("a").agg(F.min("sim").alias("s"), F.count("*").alias("k")).select(F.col("a").alias("node"), F.when(F.col("k") < size, -2.0).otherwise(F.col("s")).alias("floor"))
        rest = -2.0
    else:
        floor, rest = full.select("node", F.lit(-2.0).alias("floor")), 2.0
        both = both.join(both.join(full, "node", "left_semi").select("key").distinct(), "key", "left_semi")
    members = both.join(v.select("node", "unit"), "node").join(floor, "node", "left").select("key", "node", F.coalesce("floor", F.lit(rest)).alias("floor"), "unit")
    return _join(members, n * 2 * size, 4 if full is None else size)


def _descent(v: DataFrame, n: int, threshold: float, known: DataFrame | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame, float, int]:
    """Lists of LIST neighbours from the trees of ``seed`` (and from lists ``known``), refined until a round adds next to no links; with what :func:`_enlarged` needs."""
    grown = _trees(v, n, threshold, seed)
    lists = stored(_best(grown if known is None else grown.union(known), LIST), "lists")
    near, round_ = lists.where(F.col("sim") >= threshold - SLACK).count(), 0
    while True:  # lists only get better, so a round that gains next to nothing comes
        lists = stored(_best(lists.union(_refined(lists, v, n, round_)), LIST), "lists")
        before, near, round_ = near, lists.where(F.col("sim") >= threshold - SLACK).count(), round_ + 1
        if near - before <= GAIN * near:
            return lists, v, threshold, round_


def _saturated(lists: DataFrame, size: int, threshold: float) -> DataFrame:
    """``node``: those with ``size`` neighbours, all of them links."""
    return lists.groupBy("a").agg(F.count("*").alias("k"), F.min("sim").alias("s")).where((F.col("k") >= size) & (F.col("s") >= threshold - SLACK)).select(F.col("a").alias("node"))


def _enlarged(lists: DataFrame, v: DataFrame, threshold: float, round_: int) -> tuple[DataFrame, DataFrame]:
    """The lists, saturated ones enlarged until they are not or WIDEST is reached, and the nodes that are even then."""
    size, full = LIST, stored(_saturated(lists, LIST, threshold), "saturated")
    while (n := full.count()) and size < WIDEST:
        size *= GROW
        narrow, wide = lists.join(full.withColumnRenamed("node", "a"), "a", "left_anti").select("a", "b", "sim"), lists.join(full.withColumnRenamed("node", "a"), "a", "left_semi").select("a", "b", "sim")
        wide, near = stored(wide, "lists"), -1
        while True:
            new = _refined(narrow.union(wide), v, n, round_, size, full)
            wide, round_ = stored(_best(wide.union(new), size), "lists"), round_ + 1
            before, near = near, wide.where(F.col("sim") >= threshold - SLACK).count()
            if before >= 0 and near - before <= GAIN * near:
                break
        lists = stored(narrow.union(wide), "lists")
        full = stored(_saturated(wide, size, threshold), "saturated")
    return lists, full


def searched(asked: DataFrame, v: DataFrame, threshold: float, every: bool = False) -> DataFrame:
    """``a, n, b``: for each asked node its links in each block (n, copies counted) and, where b is given, a link; links within a component only if ``every``.

    Both sides of a space are dealt into blocks, and each block goes to the other side's blocks: every pair of vectors
    meets in one task of two blocks, whatever the size of the space."""
    parts = lambda d, name: d.groupBy("space").agg(F.ceil(F.count("*") / BLOCK).alias(name))
    grid = parts(asked, "nq").join(parts(v, "nv"), "space")
    deal = lambda m: F.pmod(F.xxhash64("node"), F.col(m))
    to_all = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1))
    q = _sized(asked.select("space", "node", "comp", "unit"), grid).withColumn("i", deal("nq")).withColumn("j", to_all("nv")).drop("nq", "nv")
    x = _sized(v.select("space", "node", "comp", "copies", "unit"), grid).withColumn("j", deal("nv")).withColumn("i", to_all("nq")).drop("nq", "nv")
    x = x.select(*[F.col(c).alias(f"v_{c}") for c in x.columns])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        counts = []
        if left.num_rows and right.num_rows:
            (qi, qc), (vi, vc, copies) = ([t.column(c).to_numpy() for c in names] for t, names in ((left, ("node", "comp")), (right, ("v_node", "v_comp", "v_copies"))))
            q, x = (_matrix(t.column(c).combine_chunks()) for t, c in ((left, "unit"), (right, "v_unit")))
            for s in range(0, len(qi), 512):
                part = slice(s, s + 512)
                hit = q[part] @ x.T >= threshold
                hit &= qi[part, None] != vi[None, :]
                n = hit @ copies
                some = np.flatnonzero(n)
                counts.append((qi[part][some], n[some]))
                if not every:
                    hit &= qc[part, None] != vc[None, :]
                i, j = np.nonzero(hit)
                out.append((qi[part][i], np.zeros(len(i), np.int64), vi[j]))
        a, n, b = (np.concatenate(c) for c in zip(*out, strict=True))
        ca, cn = (np.concatenate(c) for c in zip(*counts, strict=True)) if counts else (a[:0], n[:0])
        return pa.table({"a": np.concatenate((ca, a)), "n": np.concatenate((cn, n)), "b": pa.concat_arrays([pa.nulls(len(ca), pa.int64()), pa.array(b, pa.int64())])})

    return q.groupBy("space", "i", "j").cogroup(x.groupBy("v_space", "v_i", "v_j")).applyInArrow(run, "a long, n long, b long")


def _links(lists: DataFrame, v: DataFrame, threshold: float) -> DataFrame:
    """Pairs of the lists whose cosine, in double precision, reaches the threshold."""
    close = lists.where(F.col("sim") >= threshold - SLACK).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x, y = (v.select(F.col("node").alias(n), F.col("unit").alias("u" + n)) for n in "ab")
    dot = F.aggregate(F.zip_with("ua", "ub", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return close.join(x, "a").join(y, "b").where(dot >= threshold).select("a", "b")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``.

    Vectors of one label (and dimension) are linked if their cosine in double precision is at least ``threshold``.
    ``n_links`` counts the other vec_ids linked directly, ``component_id`` is the smallest vec_id reachable. A null label
    or embedding, an empty or zero one, or one with null or non-finite components is linked with nothing, its component
    is its own id. Repeated rows (vec_id and vector) are one vector and get equal rows; rows of one vec_id with different
    vectors are vectors of their own. A null vec_id has no links and no component and is kept. Other columns are not read.
    """
    ship(vectors.sparkSession)
    v = stored(nodes(vectors), "vectors")
    n = v.count()
    lists, asked = _enlarged(*_descent(v, n, threshold))
    links = stored(_links(lists, v, threshold), "links")
    alone = v.withColumn("comp", F.col("node"))
    # the audit: brute force for sampled vectors that are not compared with all anyway
    draw = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 30)) < min(1 << 30, math.ceil((1 << 30) * AUDIT / max(1, n)))
    sample = stored(alone.join(asked, "node", "left_anti").where(draw).orderBy("node").limit(AUDIT), "audit")
    truth = stored(searched(sample, alone, threshold, every=True).where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "audit")
    total, again = truth.count(), 0
    while (met := truth.join(links, ["a", "b"], "left_semi").count()) < RECALL * total and again < AGAIN:
        again += 1
        lists, asked = _enlarged(*_descent(v, n, threshold, lists, 1 + again))
        links = stored(_links(lists, v, threshold), "links")
    (log.warning if met < RECALL * total else log.info)("audit: %d of %d links of %d sampled vectors are in the lists", met, total, min(n, AUDIT))
    found = connected_components(links)
    comp = v.join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("comp", F.coalesce("component_id", "node")).drop("component_id")
    comp = stored(comp, "vectors")
    extra = stored(searched(comp.join(asked, "node", "left_semi"), comp, threshold), "searched")
    links = stored(links.union(extra.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).union(truth).distinct(), "links")
    found = connected_components(links)
    copies = v.select(F.col("node").alias("b"), F.col("copies").alias("n"))
    listed = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(copies, "b").groupBy("a").agg(F.sum("n").alias("n"))
    exact = extra.groupBy("a").agg(F.sum("n").alias("m"))
    out = v.join(found.withColumnRenamed("id", "node"), "node", "left").join(listed.withColumnRenamed("a", "node"), "node", "left").join(exact.withColumnRenamed("a", "node"), "node", "left")
    out = out.select("node", F.coalesce("component_id", "node").alias("comp"), "first_id", (F.col("copies") - 1 + F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0)))).alias("n_links"))
    out = stored(out, "nodes")
    first = out.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    out = out.join(first, "comp").select("node", "n_links", "component_id")
    embedding = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.xxhash64(F.concat_ws("/", F.size(embedding).cast("string"), F.col("label").cast("string")), embedding)).alias("node"))
    out = rows.join(out, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
