"""Page fingerprints and every pair of them within a Hamming distance, by multi-index hashing."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators import skew
from folioscope.operators.components import stored
from folioscope.operators.ship import ship

#: Prints from which common band values are learnt (any order of bands gives the same pairs), and the share from which a value is common.
LEARNT, COMMON = 65_536, 16
#: Prints of a block and rows of it compared at a time; prints on which keys are tried, and pairs for each meeting by a key below which all pairs are compared.
BLOCK, ROWS, TRIED, DENSE = 4096, 32, 2048, 4


def page_prints(rasters: DataFrame, key: str, n: int = 32) -> DataFrame:
    """``key, print`` of ``rasters(key, w, h, px)``, grey values row by row: 2 * n * n bits, packed in longs.

    Means of an (n + 1) by (n + 1) grid, each cell at least one pixel wide and high; a bit says whether a cell is brighter
    than the one to its right, then whether it is than the one below. Null for a raster without pixels or with too few.
    """
    size = n + 1
    lo = lambda i, m: F.floor(i * F.col(m) / size).cast("int")
    hi = lambda i, m: F.greatest(lo(i, m) + 1, F.floor((i + 1) * F.col(m) / size).cast("int"))

    def mean(c: Column) -> Column:
        x, y = c % size, F.floor(c / size).cast("int")
        total = F.aggregate(F.sequence(lo(y, "h"), hi(y, "h") - 1), F.lit(0.0), lambda s, r: s + F.aggregate(F.slice("px", r * F.col("w") + lo(x, "w") + 1, hi(x, "w") - lo(x, "w")), F.lit(0.0), lambda a, p: a + p))
        return total / ((hi(y, "h") - lo(y, "h")) * (hi(x, "w") - lo(x, "w")))

    whole = (F.col("w") > 0) & (F.col("h") > 0) & (F.size("px") >= F.col("w") * F.col("h"))
    grid = rasters.select(key, F.when(whole, F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), mean)).alias("grid"))
    at = lambda k: F.get("grid", (F.floor(k % (n * n) / n) * size + k % n).cast("int"))
    step = lambda k: F.when(k < n * n, 1).otherwise(size)
    bit = lambda k: at(k) > F.get("grid", (F.floor(k % (n * n) / n) * size + k % n + step(k)).cast("int"))
    word = lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, j: F.shiftleft(a, 1).bitwiseOR(F.when(bit(i * 64 + j), 1).otherwise(0).cast("long")))
    return grid.select(key, F.when(F.col("grid").isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(2 * n * n // 64 - 1)), word)).alias("print"))


def distance(a: Column, b: Column) -> Column:
    """Bits in which two packed prints differ; null if their lengths do."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x))


def index_of(most: int, bits: int, n: int) -> tuple[int, int]:
    """Bands and flips within a band that find all pairs of ``n`` prints of ``bits`` bits that differ in at most ``most``.

    A band is as long as it takes to tell n prints apart. Where that leaves fewer bands than most + 1, bands are twice as long
    and are met with one flipped bit too: of most // 2 + 1 bands one has at most one difference.
    """
    long = max(8, math.ceil(math.log2(max(2, n))))
    return (bits // long, 0) if bits // long > most else (max(most // 2 + 1, math.ceil(bits / 63)), 1)


def _bands(m: int) -> Column:
    """The values of m bands of ``print``, each of at most 64 bits, as array<struct<b, v>>."""
    return F.expr(f"""transform(transform(sequence(0, {m} - 1), b -> struct(b, b * 64 * size(print) div {m} as s, (b + 1) * 64 * size(print) div {m} as e)), x -> struct(x.b as b,
    if(x.e = x.s, 0L, shiftrightunsigned(shiftleft(print[cast(x.s div 64 as int)], cast(x.s % 64 as int)) | if(x.s % 64 + x.e - x.s > 64, shiftrightunsigned(print[cast(x.s div 64 as int) + 1], cast(64 - x.s % 64 as int)), 0L), cast(64 - (x.e - x.s) as int))) as v,
    cast(x.e - x.s as int) as w))""")


def _later(left: DataFrame, more_pages: int) -> DataFrame:
    """``left`` once for each number of pages n that a partner may have; its own is ``na``."""
    return left.withColumnRenamed("n", "na").withColumn("n", F.explode(F.sequence(F.col("na"), F.col("na") + more_pages)))


def _pairs(left: DataFrame, right: DataFrame, on: list[str]) -> float:
    """Rows that a join would have."""
    each = lambda d, c: d.groupBy(*on).agg(F.count("*").cast("double").alias(c))
    return each(left, "c").join(each(right, "d"), on).agg(F.coalesce(F.sum(F.col("c") * F.col("d")), F.lit(0.0))).first()[0]


def _sampled(count: int, most: int) -> Column:
    return F.pmod(F.xxhash64("rep", "side"), F.lit(max(1, count))) < most


def compared(nodes: DataFrame, most: int, more_pages: int) -> DataFrame:
    """``side, a, b, distance`` of nodes(side, rep, n, print) by comparing all pairs that may be linked.

    Prints of one side, length and n are dealt into blocks, and each block goes to those it is compared with: every pair
    meets in one task of two blocks, whatever the number of prints.
    """
    ship(nodes.sparkSession)
    v = nodes.select("side", "rep", "n", F.size("print").alias("size"), "print")
    group = ["side", "size", "n"]
    parts = stored(v.groupBy(*group).agg(F.ceil(F.count("*") / BLOCK).alias("parts")), "parts")
    grid = _later(parts.withColumnRenamed("parts", "pa"), more_pages).join(parts.withColumnRenamed("parts", "pb"), group)
    grid = grid.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pa") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pb") - 1)))
    grid = grid.where("na < n or i <= j").select("side", "size", "na", "i", F.col("n").alias("nb"), "j")
    dealt = stored(v.join(parts, group).withColumn("k", F.pmod(F.xxhash64("rep"), "parts")).drop("parts"), "blocks")
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number that is asked for is kept: prints are few bytes, their pairs are many
    by = ["side", "size", "na", "i", "nb", "j"]
    a = dealt.withColumnsRenamed({"n": "na", "k": "i"}).join(grid, ["side", "size", "na", "i"]).select(*by, "rep", "print").repartition(tasks, *by)
    b = dealt.withColumnsRenamed({"n": "nb", "k": "j"}).join(grid, ["side", "size", "nb", "j"]).select(*[F.col(c).alias(f"v_{c}") for c in (*by, "rep", "print")]).repartition(tasks, *[f"v_{c}" for c in by])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        if left.num_rows and right.num_rows:
            matrix = lambda c: np.ascontiguousarray(c.combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(c), -1).T)
            x, y, xi, yi = matrix(left.column("print")), matrix(right.column("v_print")), left.column("rep").to_numpy(), right.column("v_rep").to_numpy()
            one = left.column("na")[0].as_py() == left.column("nb")[0].as_py()
            own = one and left.column("i")[0].as_py() == left.column("j")[0].as_py()
            for s in range(0, len(xi), ROWS):
                d = np.zeros((len(xi[s : s + ROWS]), len(yi)), np.int32)
                for p, q in zip(x[:, s : s + ROWS], y, strict=True):
                    d += np.bitwise_count(p[:, None] ^ q)
                p, q = np.nonzero(d <= most)
                p, q, d = xi[s : s + ROWS][p], yi[q], d[p, q].astype(np.int64)
                if own:
                    p, q, d = (c[p < q] for c in (p, q, d))
                out.append((np.minimum(p, q), np.maximum(p, q), d) if one else (p, q, d))
        p, q, d = map(np.concatenate, zip(*out, strict=True))
        name = left.column("side")[0].as_py() if left.num_rows else ""
        return pa.table({"side": pa.array([name] * len(p), pa.string()), "a": p, "b": q, "distance": d})

    return a.groupBy(*by).cogroup(b.groupBy(*[f"v_{c}" for c in by])).applyInArrow(run, "side string, a long, b long, distance long")


def near_prints(pages: DataFrame, most: int = 100, more_pages: int = 2) -> tuple[DataFrame, DataFrame]:
    """Links ``side, a, b, distance`` between different prints of ``pages(id, n, first, last)``, and members ``id, side, rep``.

    Equal prints of documents with equally many pages n are one, named by the smallest id (``rep``): members of one rep are
    near each other. Two prints of a side (the first or the last page) are linked if they differ in at most ``most`` bits and one
    document has 0 to ``more_pages`` pages more; a is the one with fewer pages, then the smaller id. Prints of different
    lengths are never near; null prints, ids and n have no part. Repeated rows count once. No pair is missed.

    Each band of a print is a key. Near prints agree in all bands but ``most``, so by any fixed order of keys the first most + 1
    of each share one: common values (blank margins) are put last, so they seldom become keys at all. Where keys still bring
    together as many as a quarter of all pairs (bands of few values), as tried on a sample, all pairs are :func:`compared`.
    """
    side = F.explode(F.array(F.struct(F.lit("first").alias("side"), F.col("first").alias("print")), F.struct(F.lit("last").alias("side"), F.col("last").alias("print"))))
    each = pages.select(F.col("id").cast("long").alias("id"), F.col("n").cast("long").alias("n"), side.alias("x")).select("id", "n", "x.*")
    each = stored(each.where("id is not null and n is not null and print is not null and size(print) > 0 and forall(print, x -> x is not null)").withColumn("h1", F.xxhash64("n", "print")).withColumn("h2", F.xxhash64("print", F.lit(5), "n")), "prints")
    nodes = stored(each.groupBy("side", "h1", "h2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("print").alias("print")), "nodes")
    members = skew.lookup(each.select("id", "side", "h1", "h2").distinct(), nodes.select("side", "h1", "h2", "rep"), ["side", "h1", "h2"]).select("id", "side", "rep")
    count, bits = nodes.agg(F.count("*"), F.coalesce(F.max(F.size("print")), F.lit(1)) * 64).first()
    m, flips = index_of(most, bits, count)
    banded = nodes.select("side", "rep", "n", F.size("print").alias("size"), _bands(m).alias("bands"))
    if not flips:
        sample = banded.where(_sampled(count, LEARNT))
        seen = sample.select(F.explode("bands").alias("x")).groupBy(F.col("x.b").alias("b"), F.col("x.v").alias("v")).agg(F.count("*").alias("c"))
        common = seen.where(F.col("c") * COMMON > min(count, LEARNT)).groupBy("b").agg(F.collect_list(F.struct("v", "c")).alias("common"))  # under COMMON values a band
        by_band = nodes.sparkSession.range(m).select(F.col("id").cast("int").alias("b")).join(common, "b", "left")
        table = stored(by_band.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", F.coalesce("common", F.array()).alias("common")))), lambda x: x["common"]).alias("table")), "common").scalar()

    def keyed(d: DataFrame) -> tuple[DataFrame, DataFrame]:
        if flips:
            own = F.explode("bands")
            flipped = F.expr("concat(array(x.v), transform(filter(sequence(0, 63), j -> j < x.w), j -> x.v ^ shiftleft(1L, j)))")
            left = d.select("side", F.col("rep").alias("a"), "n", "size", own.alias("x")).select("side", "a", "n", "size", F.col("x.b").alias("band"), F.explode(flipped).alias("v"))
            right = d.select("side", F.col("rep").alias("b"), "n", "size", own.alias("x")).select("side", "b", "n", "size", F.col("x.b").alias("band"), F.col("x.v").alias("v"))
        else:
            weight = F.expr("transform(bands, x -> struct(coalesce(get(filter(table[x.b], y -> y.v = x.v), 0).c, 0L) as c, x.b as b, x.v as v))")
            keys = d.withColumn("table", table).select("side", "rep", "n", "size", F.explode(F.slice(F.array_sort(weight), 1, most + 1)).alias("x"))
            keys = keys.select("side", "rep", "n", "size", F.col("x.b").alias("band"), F.col("x.v").alias("v"))
            left, right = keys.withColumnRenamed("rep", "a"), keys.withColumnRenamed("rep", "b")
        return _later(left, more_pages), right

    tried = stored(banded.where(_sampled(count, TRIED)), "tried")
    by_key = keyed(tried)
    met = _pairs(*by_key, ["side", "size", "band", "v", "n"]) - by_key[1].count()  # each meets itself by all its keys
    if DENSE * met > _pairs(_later(tried, more_pages), tried, ["side", "size", "n"]) - tried.count():
        return compared(nodes, most, more_pages), members
    left, right = keyed(banded)
    met = left.join(right, ["side", "size", "band", "v", "n"]).where("n > na or a < b").select("side", "a", "b").distinct()
    met = stored(met, "met")
    prints = nodes.select("side", "rep", "print")
    for end in ("a", "b"):
        met = stored(skew.lookup(met, prints.withColumnRenamed("rep", end).withColumnRenamed("print", f"print_{end}"), ["side", end]), "met")
    return met.select("side", "a", "b", distance(F.col("print_a"), F.col("print_b")).cast("long").alias("distance")).where(F.col("distance") <= most), members
