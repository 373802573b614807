"""Hard negatives for anchors, by k-means inverted lists with stored centroid radii.

Vectors lie in lists around centroids, and each list stores its radius. By Cauchy-Schwarz no member of a list scores more
than q.c + |q| r with a query q, nor less than q.c - |q| r. A query visits lists in the order of the upper bound, skips
those whose bounds lie outside its windows, and stops when the bound falls strictly below its kth score, so what it finds
is exact. Visits go in waves, each four times as wide as the one before; between waves the kth scores are brought up.

Scores are inner products of integers and are computed exactly. Equal vectors of one label can only be told apart by
their ids, so all but the smallest of these are left out of the lists, and equal anchors are one query.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators import skew
from folioscope.operators.components import stored
from folioscope.operators.ship import ship

#: Most lists (with at most ``NUMBERS`` numbers in their centroids: 32 MB), rows a list that centroids are fitted on, and rounds of the fit.
LISTS, NUMBERS, PER_LIST, ROUNDS = 4096, 1 << 22, 16, 5
#: Rows of a list and queries that are compared at a time, rows in a bin of such pairs, lists visited first, and how much wider each wave is.
BLOCK, CHUNK, BIN, FIRST, WIDER = 4096, 1024, 16_384, 4, 4
#: Vectors of this squared length and more take no part, so that 100 times a score fits in a long.
LONGEST = 1 << 55
LOW, HIGH = -(1 << 62), 1 << 62
KEY = ["q1", "q2"]


def prepared(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, label, v``: distinct usable rows, each component x as floor(scale * x). Shorter vectors are filled up with zeros."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    v = v.where("vec_id is not null and label is not null and x is not null and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    v = v.withColumn("scaled", F.transform("x", lambda c: F.floor(c * scale)))
    v = v.where(F.aggregate("x", F.lit(0.0), lambda s, c: s + F.floor(c * scale).cast("double") * F.floor(c * scale).cast("double")) < float(LONGEST))
    v = stored(v.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v")).distinct(), "vectors")
    least, most = v.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    return v if least == most else v.withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.coalesce(F.get("v", i), F.lit(0).cast("long"))))


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


class Index:
    """Inverted lists: ``members(list, block, vec_id, label, v)`` stored, and for each list its centroid, radius, rows and blocks."""

    def __init__(self, rows: DataFrame, dims: int, n: int):
        spark = rows.sparkSession
        most = max(1, min(LISTS, NUMBERS // max(1, dims), math.ceil(math.sqrt(n))))
        sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(n)) < PER_LIST * most)
        points = sample.select(array_to_vector(F.col("v").cast("array<double>")).alias("features"))
        fitted = dims > 0 and points.limit(1).count()
        centres = np.array(KMeans(k=most, maxIter=ROUNDS, initMode="random", seed=5).fit(points).clusterCenters()) if fitted and most > 1 else np.zeros((1, dims))
        held = spark.sparkContext.broadcast(centres)

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = held.value
            for b in batches:
                x = _matrix(b.column(2), dims).astype(np.float64)
                at = np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, 1)
                far = np.sqrt(((x - c[at]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(far), *b.columns], names=["list", "far", "vec_id", "label", "v"])

        rows = stored(rows.select("vec_id", "label", "v").mapInArrow(assigned, "list int, far double, vec_id long, label long, v array<long>"), "assigned")
        sizes = {r["list"]: (r.far, r.n) for r in rows.groupBy("list").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}  # a row for each list
        self.numbers = np.array(sorted(sizes), dtype=np.int64)
        self.centres = centres[self.numbers]
        self.radii = np.array([sizes[i][0] for i in self.numbers])
        self.rows = {i: sizes[i][1] for i in sizes}
        self.blocks = {i: math.ceil(n / BLOCK) for i, n in self.rows.items()}
        self.dims, self.spark = dims, spark
        self.members = rows.drop("far").join(F.broadcast(self._by_list(self.blocks, "blocks")), "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).drop("blocks")

    def _by_list(self, numbers: dict[int, int], name: str) -> DataFrame:
        return self.spark.createDataFrame([(int(i), int(x)) for i, x in numbers.items()], f"list int, {name} int")

    def _to_visit(self, begin: int, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        held = self.spark.sparkContext.broadcast((self.numbers, self.centres, self.radii))
        dims = self.dims

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, centres, radii = held.value
            for b in batches:
                q = _matrix(b.column("v"), dims).astype(np.float64)
                long = np.sqrt((q * q).sum(1))[:, None]
                dot = q @ centres.T
                reach = long * radii[None, :]
                reach += 1e-9 * (reach + long * np.sqrt((centres**2).sum(1))[None, :]) + 1e-3  # rounding must not cut a bound
                upper, lower = dot + reach, dot - reach
                lists, more = [], []
                los, his, kths = (b.column(c).to_pylist() for c in ("lo", "hi", "kth"))
                for i in range(len(q)):
                    wanted = np.zeros(len(numbers), bool)
                    for lo, hi, kth in zip(los[i], his[i], kths[i], strict=True):
                        wanted |= (upper[i] >= max(lo, kth)) & (lower[i] <= hi)
                    order = np.argsort(-upper[i], kind="stable")
                    now = order[begin:end]
                    lists.append(numbers[now[wanted[now]]].tolist())
                    more.append(bool(wanted[order[end:]].any()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(pa.int32())), pa.array(more)], names=[*b.schema.names, "lists", "more"])

        return visits

    def search(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """``q1, q2, w, score, vec_id``: for each window w of each query its ``k`` best members, ties by the smaller vec_id.

        ``queries(q1, q2, label, v, lo, hi)``: members of the same label (or, if not ``same``, of another) whose score is lo[w] to hi[w].
        """
        shape = "q1 long, q2 long, label long, v array<long>, lo array<long>, hi array<long>, kth array<long>"
        todo = queries.select(*KEY, "label", "v", "lo", "hi", F.transform("lo", lambda _: F.lit(LOW)).alias("kth"))
        hits, begin, width = None, 0, FIRST
        while True:
            wave = stored(todo.mapInArrow(self._to_visit(begin, begin + width), f"{shape}, lists array<int>, more boolean"), "wave")
            new = self._compared(wave, same, k)
            ranked = new if hits is None else hits.unionByName(new)
            best = Window.partitionBy(*KEY, "w").orderBy(F.desc("score"), F.asc("vec_id"))
            hits = stored(ranked.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r"), "hits")
            begin, width = begin + width, width * WIDER
            if begin >= len(self.numbers) or not wave.where("more").limit(1).count():
                return hits
            each = hits.groupBy(*KEY, "w").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
            kth = each.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("least"))  # an entry for each window
            todo = wave.where("more").drop("lists", "more").join(kth, KEY, "left")
            todo = todo.select(*KEY, "label", "v", "lo", "hi", F.transform("lo", lambda _, w: F.coalesce(F.element_at("least", w), F.lit(LOW))).alias("kth"))

    def _compared(self, wave: DataFrame, same: bool, k: int) -> DataFrame:
        """Queries compared with the members of the lists they visit: blocks of a list with chunks of its visitors, many pairs to a bin."""
        visits = wave.select(*KEY, "label", "v", "lo", "hi", "kth", F.explode("lists").alias("list"))
        asked = {r["list"]: r.n for r in visits.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row for each list
        chunks = {i: math.ceil(n / CHUNK) for i, n in asked.items()}
        moved = sum(self.rows[i] * chunks[i] + n * self.blocks[i] for i, n in asked.items())
        bins = max(1, moved // BIN)
        parts = F.broadcast(self._by_list(chunks, "chunks").join(self._by_list({i: self.blocks[i] for i in asked}, "blocks"), "list"))  # a row for each list
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        bin_ = F.pmod(F.xxhash64("list", "block", "chunk"), F.lit(bins)).alias("bin")
        pair = ["list", "block", "chunk"]
        left = self.members.join(parts, "list").withColumn("chunk", upto("chunks")).select(bin_, *pair, "vec_id", "label", "v")
        right = visits.join(parts, "list").withColumn("chunk", F.pmod(F.xxhash64(*KEY), "chunks").cast("int")).withColumn("block", upto("blocks")).select(bin_, *pair, *KEY, "label", "v", "lo", "hi", "kth")
        dims = self.dims
        return left.groupBy("bin").cogroup(right.groupBy("bin")).applyInArrow(lambda a, b: _bin(a, b, dims, same, k), "q1 long, q2 long, w int, score long, vec_id long")


def _groups(t: pa.Table) -> dict[tuple[int, int, int], np.ndarray]:
    """Rows of each (list, block, chunk)."""
    keys = np.stack([t.column(c).to_numpy() for c in ("list", "block", "chunk")], 1)
    each, at = np.unique(keys, axis=0, return_inverse=True)
    order = np.argsort(at.ravel(), kind="stable")
    return dict(zip(map(tuple, each.tolist()), np.split(order, np.cumsum(np.bincount(at.ravel()))[:-1]), strict=True))


def _bin(members: pa.Table, visits: pa.Table, dims: int, same: bool, k: int) -> pa.Table:
    out = [[np.zeros(0, np.int64)] * 5]
    if len(members) and len(visits):
        x, q = _matrix(members.column("v"), dims), _matrix(visits.column("v"), dims)
        ids, of, label = (t.column(c).to_numpy() for t, c in ((members, "vec_id"), (members, "label"), (visits, "label")))
        windows = [visits.column(c).to_pylist() for c in ("lo", "hi", "kth")]
        theirs, q1, q2 = _groups(visits), visits.column("q1").to_numpy(), visits.column("q2").to_numpy()
        for pair, own in _groups(members).items():
            if pair in theirs:
                own, asking = own[np.argsort(ids[own], kind="stable")], theirs[pair]
                scores = _scores(q[asking], x[own])
                fits = (of[own][None, :] == label[asking][:, None]) == same
                for w in range(max(len(windows[0][i]) for i in asking)):
                    lo = np.array([max(windows[0][i][w], windows[2][i][w]) if w < len(windows[0][i]) else HIGH for i in asking])
                    hi = np.array([windows[1][i][w] if w < len(windows[1][i]) else LOW for i in asking])
                    r, c, s = _best(np.where(fits & (scores >= lo[:, None]) & (scores <= hi[:, None]), scores, LOW), k)
                    out.append([q1[asking[r]], q2[asking[r]], np.full(len(r), w), s, ids[own[c]]])
    a, b, w, s, i = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.table({"q1": pa.array(a, pa.int64()), "q2": pa.array(b, pa.int64()), "w": pa.array(w, pa.int32()), "score": pa.array(s, pa.int64()), "vec_id": pa.array(i, pa.int64())})


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where every partial sum fits in 53 bits, else in longs."""
    longest = lambda m: np.sqrt((m.astype(np.float64) ** 2).sum(1)).max(initial=0)
    if longest(q) * longest(x) < 2**52:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def _best(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of each row's ``k`` greatest values above LOW, ties by the smaller column."""
    if s.shape[1] > k:
        floor = np.partition(s, s.shape[1] - k, 1)[:, s.shape[1] - k]
        r, c = np.nonzero((s >= floor[:, None]) & (s > LOW))
    else:
        r, c = np.nonzero(s > LOW)
    v = s[r, c]
    order = np.lexsort((c, -v, r))
    r, c, v = r[order], c[order], v[order]
    starts = np.searchsorted(r, np.arange(len(s)))
    keep = np.arange(len(r)) - starts[r] < k
    return r[keep], c[keep], v[keep]


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: hard negatives of ``vectors(vec_id, embedding, label)``.

    A score is the inner product of components floor(scale * x); higher scores come first, ties go by the smaller vec_id.
    Anchors are rows whose vec_id is divisible by ``every``; an anchor's positives are its first ``positives`` other rows of
    the same label; of an anchor and a positive, the negatives are the first ``negatives`` rows of another label whose score
    is ``percent`` to 100 per cent of the positive's (none, if that is below 0).

    Rows with a null vec_id, label or embedding, with a null or non-finite component, or of a squared scaled length of 2**55 and
    more take no part. Repeated rows count once; rows of one vec_id that differ are rows of their own, but none is another
    row to its vec_id. Labels are integers. A shorter vector is compared as if filled up with zeros, an empty one scores 0.
    An empty table gives no rows; other columns are not read.
    """
    ship(vectors.sparkSession)
    rows = prepared(vectors, scale)
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    keep = max(positives + 1, negatives)
    equal = Window.partitionBy(F.xxhash64("v"), "label", "v").orderBy("vec_id")
    index = Index(stored(rows.withColumn("r", F.row_number().over(equal)).where(F.col("r") <= keep).drop("r"), "indexed"), dims, n)
    anchors = stored(rows.where(F.col("vec_id") % every == 0).select("vec_id", F.xxhash64("label", "v").alias("q1"), F.xxhash64("v", F.lit(7), "label").alias("q2"), "label", "v"), "anchors")
    queries = stored(anchors.groupBy(*KEY).agg(F.first("label").alias("label"), F.first("v").alias("v")), "queries")
    longs = lambda x: F.array(F.lit(x).cast("long"))
    near = index.search(queries.select(*KEY, "label", "v", longs(LOW).alias("lo"), longs(HIGH).alias("hi")), True, positives + 1)
    near = stored(near.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("near")), "positives")  # positives + 1 at most
    scores = F.filter(F.array_distinct(F.transform("near", lambda p: -p["minus"])), lambda s: s >= 0)
    asked = near.withColumn("hi", scores).where("size(hi) > 0").join(queries, KEY)
    least = F.expr(f"transform(hi, s -> s * {percent} div 100 + if(s * {percent} % 100 > 0, 1, 0))")
    asked = stored(asked.select(*KEY, "label", "v", least.alias("lo"), "hi"), "asked")
    hard = index.search(asked.select(*KEY, "label", "v", "lo", "hi"), False, negatives)
    hard = hard.join(asked.select(*KEY, "hi"), KEY).select(*KEY, F.get("hi", F.col("w")).alias("positive_score"), "score", "vec_id")
    hard = hard.groupBy(*KEY, "positive_score").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("hard"))  # negatives at most
    entries = F.map_from_entries(F.collect_list(F.struct("positive_score", "hard"))).alias("hard")
    found = stored(near.join(hard.groupBy(*KEY).agg(entries), KEY), "found")
    out = skew.lookup(anchors.select(F.col("vec_id").alias("anchor_id"), *KEY), found, KEY).where("near is not null")
    own = F.slice(F.filter("near", lambda p: p["vec_id"] != F.col("anchor_id")), 1, positives)
    out = out.select("anchor_id", "hard", F.explode(own).alias("p")).select("anchor_id", F.col("p.vec_id").alias("positive_id"), (-F.col("p.minus")).alias("positive_score"), "hard")
    out = out.select("anchor_id", "positive_id", "positive_score", F.posexplode(F.element_at("hard", F.col("positive_score"))).alias("rank", "h"))
    return out.select("anchor_id", "positive_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("negative_id"), "positive_score", (-F.col("h.minus")).alias("negative_score"))


#: The same in DuckDB for ``embeddings``: every anchor against every row. Where vec_id is divisible by 7, the label is (label + 1) % 10.
SQL = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
