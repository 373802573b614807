"""Record linkage: blocked word similarity, OR keys, ranges, prefixes, cascades, manifest comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import similarity
from folioscope.operators.ship import ship


def word_pairs(a: DataFrame, b: DataFrame, share: float, ratio: float | None = None) -> DataFrame:
    """Pairs of a(id, words) and b(match, words) that may share at least ``share`` of b's words: ``id, match, words, words_b``.

    A pair that does shares one of the n - ceil(share * n) + 1 rarest of b's n words, and only these are joined. With
    ``ratio``, rows of a with over ratio * n words are left out (a Dice coefficient of t allows (2 - t) / t).
    """
    wa = a.select("id", F.size("words").alias("na"), F.explode("words").alias("w"))
    wb = b.select("match", F.size("words").alias("nb"), F.explode("words").alias("w"))
    df = wa.join(wb.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count("*").alias("df"))
    order = wb.join(df, "w", "left").withColumn("r", F.expr("row_number() over (partition by match order by coalesce(df, 0), w)"))
    rare = order.where(F.col("r") <= F.col("nb") - F.ceil(F.col("nb") * F.lit(share) - 1e-9) + 1).select("w", "match", "nb")
    hit = wa.join(rare, "w")
    if ratio is not None:
        hit = hit.where(F.col("na") <= F.col("nb") * ratio + 1e-9)
    hit = hit.select("id", "match").distinct()
    return hit.join(a.select("id", "words"), "id").join(b.select("match", F.col("words").alias("words_b")), "match")


#: Words up to which one side of the word index may be sent to every task (about 60 MB); rows counted at a time, and cells of rows by matches.
SENT, ROWS, CELLS = 2_000_000, 512, 1 << 21
#: Which pairs of some rows (first axis) are wanted, by words shared, of each row, of each match.
Keep = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def shared_words(a: DataFrame, b: DataFrame, keep: Keep | None = None) -> DataFrame:
    """The columns of a without its words, and ``match, na, nb, shared``, for all pairs of a(id, words, ...) and b(match, words) with a word in common.

    Words of b that are few are sent out, and rows of a are counted against them where they are read: nothing is shuffled. Else it is one
    join on words and partial sums for each pair. ``keep`` may leave out pairs that others of the same rows make needless; the join keeps all.
    """
    if _few(b):
        return _counted(a, b, keep)
    own = [c for c in a.columns if c != "words"]
    wa = a.select(*own, F.size("words").alias("na"), F.explode("words").alias("w"))
    wb = b.select("match", F.size("words").alias("nb"), F.explode("words").alias("w"))
    return wa.join(wb, "w").groupBy(*own, "match", "na", "nb").agg(F.count("*").alias("shared"))


def _few(b: DataFrame) -> bool:
    return b.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0] <= SENT


def _counted(a: DataFrame, b: DataFrame, keep: Keep | None) -> DataFrame:
    spark = a.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(b.where("words is not null").select("match", "words").toArrow().combine_chunks())  # SENT words at most
    own = [c for c in a.columns if c != "words"]
    found = T.StructType([b.schema["match"], T.StructField("nb", T.IntegerType()), T.StructField("shared", T.LongType())])
    schema = T.StructType([*(a.schema[c] for c in own), T.StructField("na", T.IntegerType()), T.StructField("x", T.ArrayType(found))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, lists = (pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in (sent.value.column(n) for n in ("match", "words")))
        m, nb = len(match), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        vocabulary = flat.unique()
        code = pc.index_in(flat, value_set=vocabulary).to_numpy(zero_copy_only=False)
        items = np.repeat(np.arange(m), nb)[np.argsort(code, kind="stable")]
        many = np.bincount(code, minlength=len(vocabulary))
        starts = np.cumsum(many) - many
        rows = max(1, min(ROWS, CELLS // max(1, m)))
        for batch in batches:
            words = batch.column(batch.schema.get_field_index("words"))
            na = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = pc.fill_null(pc.index_in(words.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(na)
            for s in range(0, batch.num_rows if m else 0, rows):
                n = na[s : s + rows]
                c = codes[ends[s] - n[0] : ends[s + len(n) - 1]]
                row = np.repeat(np.arange(len(n)), n)[c >= 0]
                c = c[c >= 0]
                each = many[c]
                at = np.arange(each.sum()) + np.repeat(starts[c] - np.cumsum(each) + each, each)
                shared = np.bincount(np.repeat(row, each) * m + items[at], minlength=len(n) * m).reshape(len(n), m)
                some = shared > 0
                if keep is not None:
                    some &= keep(shared, n[:, None], nb[None, :])
                i, j = np.nonzero(some)
                x = pa.StructArray.from_arrays([match.take(pa.array(j)), pa.array(nb[j].astype(np.int32)), pa.array(shared[i, j].astype(np.int64))], ["match", "nb", "shared"])
                bounds = pa.array(np.concatenate(([0], np.cumsum(some.sum(1)))).astype(np.int32))
                part = batch.slice(s, len(n))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in own), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(bounds, x)], [*own, "na", "x"])

    return a.mapInArrow(run, schema).select(*own, "na", F.explode("x").alias("x")).select(*own, "x.match", "na", "x.nb", "x.shared")


def word_links(a: DataFrame, b: DataFrame, share: float, ratio: float | None = None) -> DataFrame:
    """``id, match, na, nb, shared`` for the pairs of :func:`word_pairs`, or fewer: none that shares less is needed. Words of b that are few are counted where a is read."""
    if _few(b):

        def keep(shared: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
            some = shared >= nb * share - 1e-9
            return some if ratio is None else some & (na <= nb * ratio + 1e-9)

        return _counted(a.select("id", "words"), b, keep)
    pairs = word_pairs(a, b, share, ratio)
    return pairs.select("id", "match", F.size("words").alias("na"), F.size("words_b").alias("nb"), F.size(F.array_intersect("words", "words_b")).cast("long").alias("shared"))


def _without(c: Column, i: Column) -> Column:
    return F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1))


def _left(c: Column, k: int) -> Column:
    """The strings that a string leaves when k of its characters go (all, where it has fewer)."""
    one = lambda x: F.when(F.length(x) >= 1, F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: _without(x, i))).otherwise(F.array(x))
    out = F.array(c)
    for _ in range(k):
        out = F.array_distinct(F.flatten(F.transform(out, one)))
    return out


def _masked(c: Column) -> Column:
    """array<struct<i, j, rest, ci, cj>>: a string with two of its characters taken out, and where they stood; i = j where it has fewer."""
    n, at = F.length(c), lambda i: F.substr(c, i + 1, F.lit(1))
    parts = lambda i, j, rest, ci, cj: F.struct(i.alias("i"), j.alias("j"), rest.alias("rest"), ci.alias("ci"), cj.alias("cj"))
    pair = lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: parts(i, j, _without(_without(c, j + 1), i + 1), at(i), at(j)))
    return F.when(n >= 2, F.flatten(F.transform(F.sequence(F.lit(0), n - 2), pair))).otherwise(F.array(parts(-n, -n, F.lit(""), c, c)))


def _short_names(x: DataFrame, y: DataFrame) -> DataFrame:
    """``a, b`` for all pairs of x(a) and y(b), of up to 11 characters each, that two edits may lie between, each pair once.

    Of one length they differ in two places at most, so they are equal without these (one choice of places counts for a pair);
    or one character goes and one comes, so a deletion in each leaves the same. Of other lengths, the longer leaves by
    two deletions what the shorter leaves by one or none. Only lengths that the other side has are looked for.
    """
    x, y = x.withColumn("m", F.length("a")), y.withColumn("n", F.length("b"))
    sizes = lambda d, c, to: F.broadcast(d.select(F.col(c).alias(to)).distinct())  # noqa: E731  at most twelve
    same_x, same_y = x.join(sizes(y, "n", "m"), "m", "left_semi"), y.join(sizes(x, "m", "n"), "n", "left_semi")
    key = lambda d, c, size: d.select(c, size, F.explode(_masked(F.col(c))).alias("x")).select(c, F.col(size).alias("n"), "x.i", "x.j", "x.rest", F.col("x.ci").alias(f"i{c}"), F.col("x.cj").alias(f"j{c}"))
    met = key(same_x, "a", "m").join(key(same_y, "b", "n"), ["n", "i", "j", "rest"])
    di, dj, first = F.col("ia") != F.col("ib"), F.col("ja") != F.col("jb"), F.col("i") == 0
    replaced = met.where((F.col("i") == F.col("j")) | di & dj | first & dj | first & (F.col("j") == 1)).select("a", "b")
    gone = lambda d, c, size: d.select(c, F.col(size).alias("n"), F.explode(_left(F.col(c), 1)).alias("k"))
    far = F.size(F.filter(F.sequence(F.lit(1), F.length("a")), lambda i: F.substr("a", i, F.lit(1)) != F.substr("b", i, F.lit(1)))) > 2
    moved = gone(same_x.where("m > 2"), "a", "m").join(gone(same_y.where("n > 2"), "b", "n"), ["n", "k"]).where(far).select("a", "b").distinct()

    def other(d: DataFrame, c: str, own: str, to: str, there: DataFrame) -> DataFrame:
        d = d.withColumn(to, F.explode(F.transform(F.array(*map(F.lit, (-2, -1, 1, 2))), lambda by: F.col(own) + by))).join(sizes(there, to, to), to, "left_semi")
        by = F.col(to) - F.col(own)
        keys = F.when(by < 0, _left(F.col(c), 2)).when(by == 1, _left(F.col(c), 1)).otherwise(F.array(c))
        return d.select(c, "m", "n", F.explode(keys).alias("k"))

    longer = other(x, "a", "m", "n", y).join(other(y, "b", "n", "m", x), ["m", "n", "k"]).select("a", "b").distinct()
    return replaced.union(moved).union(longer)


def _most(longest: Column) -> Column:
    return F.greatest(F.lit(2), F.floor(longest / 4).cast("int"))


def _parts(n: Column, cut: Column) -> Column:
    """array<struct(at, len)>: where the pieces stand of a string of n characters cut into so many."""
    edge = lambda i: F.floor(i * n / cut).cast("int")
    return F.transform(F.sequence(F.lit(0), cut - 1), lambda i: F.struct(i.alias("i"), edge(i).alias("at"), (edge(i + 1) - edge(i)).alias("len")))


def _long_names(x: DataFrame, y: DataFrame) -> DataFrame:
    """``a, b`` for pairs of x(a) and y(b), one of them of over 11 characters, that share a piece almost where it stands."""
    n = F.length("b")
    pieces = F.transform(_parts(n, F.floor(n / 3).cast("int") + 1), lambda p: F.struct(n.alias("n"), p["i"].alias("i"), F.substr("b", p["at"] + 1, p["len"]).alias("s")))
    m = F.length("a")

    def near(size: Column) -> Column:
        """Pieces of a string of ``size`` characters as they may stand in a."""
        d = _most(F.greatest(m, size))
        moved = lambda p: F.transform(F.sequence(-d, d), lambda by: F.struct((p["at"] + by).alias("at"), p["len"].alias("len"), p["i"].alias("i")))
        at = F.flatten(F.transform(_parts(size, F.floor(size / 3).cast("int") + 1), moved))
        inside = F.filter(at, lambda p: (p["at"] >= 0) & (p["at"] + p["len"] <= m))
        return F.transform(inside, lambda p: F.struct(size.alias("n"), p["i"].alias("i"), F.substr("a", p["at"] + 1, p["len"]).alias("s")))

    reach = F.floor(m / 3).cast("int") + 1
    least = F.when(m > 11, 9).otherwise(12)  # one of the two has over 11
    keys = F.array_distinct(F.flatten(F.transform(F.sequence(F.greatest(least, m - reach), m + reach), near)))
    return x.where(m >= 9).select("a", F.explode(keys).alias("k")).join(y.where(n >= 9).select("b", F.explode(pieces).alias("k")), "k").select("a", "b").distinct()


def similar_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a, b`` for all pairs of different strings of a(a) and b(b) that are alike by :func:`similarity.surname_like`.

    Two of up to 11 characters differ by at most two edits (:func:`_short_names`).
    Of longer ones, cut into one piece more than there may be edits, a piece stands in the other almost where it was.
    """
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number that is asked for is kept: names are few bytes, their keys are many
    x, y = (d.where(f"{c} is not null").select(c).distinct().repartition(tasks) for d, c in ((a, "a"), (b, "b")))
    short = _short_names(x.where(F.length("a") <= 11), y.where(F.length("b") <= 11))
    return short.union(_long_names(x, y)).where(similarity.surname_like(F.col("a"), F.col("b")))


def or_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_id: str, right_id: str) -> DataFrame:
    """Pairs equal in any of the keys: a union of equi-joins, each pair once, instead of one join on OR."""
    parts = [left.select(left_id, F.col(a).cast("string").alias("k")).join(right.select(right_id, F.col(b).cast("string").alias("k")), "k").select(left_id, right_id) for a, b in keys]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def range_join(points: DataFrame, ranges: DataFrame, x: str, lo: str, hi: str, width: float) -> DataFrame:
    """Points within closed ranges, by buckets of ``width``: ranges go to every bucket they touch, points to one."""
    p = points.withColumn("__bucket", F.floor(F.col(x) / width))
    r = ranges.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return p.join(r, "__bucket").where(F.col(x).between(F.col(lo), F.col(hi))).drop("__bucket")


def ancestors(path: Column) -> Column:
    """array<struct(prefix, depth)> of a slashed path, itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("prefix"), n.alias("depth")))


def nearest_ancestor(paths: DataFrame, known: DataFrame, path: str, key: str) -> DataFrame:
    """``key, prefix, depth``: the longest prefix of each path that is known(prefix)."""
    each = paths.select(key, F.explode(ancestors(F.col(path))).alias("x")).select(key, "x.*")
    found = each.join(known.select("prefix").distinct(), "prefix", "left_semi")
    return found.groupBy(key).agg(F.max_by("prefix", "depth").alias("prefix"), F.max("depth").alias("depth"))


def manifest_diff(needed: DataFrame, present: DataFrame, key: str, size: str, when: str, slack: int) -> DataFrame:
    """``key, action``: 'same', 'copy' or 'delete'. Same needs equal size and times within ``slack`` seconds."""
    p = present.select(F.col(key).alias("__k"), F.col(size).alias("__s"), F.col(when).alias("__t"))
    both = needed.select(key, size, when).join(p, F.col(key) == F.col("__k"), "full_outer")
    close = F.abs(F.unix_timestamp(when) - F.unix_timestamp("__t")) <= slack
    action = F.when(F.col(key).isNull(), "delete").when(F.col("__k").isNull(), "copy").when((F.col(size) == F.col("__s")) & close, "same").otherwise("copy")
    return both.select(F.coalesce(key, "__k").alias(key), action.alias("action"))


def cascade(frames: list[DataFrame], key: str, value: str) -> DataFrame:
    """``key, value, step``: the answer of the first step that has exactly one for the key; a step with several stops it."""
    out = None
    for i, f in enumerate(frames):
        one = f.select(key, F.col(value).alias("v"), F.lit(i).alias("step"))
        out = one if out is None else out.union(one)
    per = out.groupBy(key, "step").agg(F.count_distinct("v").alias("n"), F.min("v").alias("v"))
    first = per.groupBy(key).agg(F.min_by(F.struct("n", "v", "step"), "step").alias("x"))
    return first.where("x.n = 1").select(key, F.col("x.v").alias(value), F.col("x.step").alias("step"))


def accepted(words_a: Column, words_b: Column, surname_same: Column, surname_missing: Column) -> Column:
    """Whether two works of compatible years are the same by title words and surname."""
    d, c = similarity.dice_of(words_a, words_b), F.greatest(similarity.containment_of(words_a, words_b), similarity.containment_of(words_b, words_a))
    return (surname_same & ((d >= 0.8) | (c >= 0.85))) | (surname_missing & ((d >= 0.9) | (c >= 0.92)))
