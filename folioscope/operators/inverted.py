"""An inverted index that is kept up in segments, and ranked search over its postings.

Each batch of changed records becomes a segment: postings, and changes of document frequencies and of the corpus' figures.
A record is a posting of the empty word, with its version, so that a later one or a deletion outdates what older segments
hold. Texts are shuffled once, by the part of their key; their postings are made where they are read and are not shuffled:
a part's file is sorted by token, so a search reads few pages of it. Nothing older is rewritten; when ``FAN`` segments of
about one size have gathered, they are merged into one and outdated rows go. A manifest row, appended last, makes a change
visible, so a batch that failed or is run again does no harm.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.functions.similarity import round6
from folioscope.operators.components import stored
from folioscope.operators.prefilter import marked, probably_in
from folioscope.operators.search import LIMIT, MOST, Term
from folioscope.operators.ship import ship

#: Segments of one size that are merged, the factor between sizes, and parts by key, so that a batch reads only the parts of its keys.
FAN, TIER, PARTS = 4, 4, 64
#: Outdated records that are sent to the postings; where there are more, the postings that may be theirs are shuffled.
SENT = 1 << 20
MANIFEST = "sequence long, version long, segments array<struct<name: string, rows: long>>"
#: The empty word of a record stands at its length; that of a deletion nowhere.
POSTINGS = "token string, field string, key long, version long, positions array<int>, part int"
HELD = "token string, field string, key long, version long, part int"
FREQUENCIES = "token string, field string, n long"
FIGURES = "n long, len long"


def _postings(fields: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows ``key, version, deleted, part`` and normalised ``f0, f1 ...``: ``POSTINGS``, with the places of a word from 0. Each batch comes sorted, so that a sort has only to merge."""
    named = pa.array(["", *fields], pa.string())
    rank = np.argsort(np.argsort(named.to_pylist()))  # 0 for the record itself

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, at, of, found, size = b.num_rows, [], [], [], np.zeros(b.num_rows, np.int64)
            for i in range(len(fields)):
                split = pc.split_pattern(b.column(f"f{i}").cast(pa.string()), " ")
                words, row = split.flatten(), pc.list_parent_indices(split).to_numpy().astype(np.int64)
                place = np.arange(len(row), dtype=np.int64) - np.searchsorted(row, row)
                there = pc.not_equal(words, "")  # an empty text is one empty word
                keep = there.to_numpy(zero_copy_only=False)
                at.append(place[keep])
                of.append(row[keep] * len(named) + rank[i + 1])
                found.append(words.filter(there))
                size += np.bincount(row[keep], minlength=n)
            live = np.flatnonzero(~b.column("deleted").to_numpy(zero_copy_only=False))
            gone = np.flatnonzero(b.column("deleted").to_numpy(zero_copy_only=False))
            own = np.concatenate([live, gone])
            at, of = np.concatenate([*at, size[live], np.full(len(gone), -1)]), np.concatenate([*of, own * len(named)])
            coded = pa.concat_arrays([*found, pa.array([""] * n, pa.string())]).dictionary_encode()
            alphabet = pc.sort_indices(coded.dictionary).to_numpy()
            word = np.empty(len(alphabet), np.int64)
            word[alphabet] = np.arange(len(alphabet))
            code, row = word[coded.indices.to_numpy()], of // len(named)
            part = b.column("part").to_numpy().astype(np.int64)
            group = ((part[row] * len(alphabet) + code) * len(named) + of % len(named)) * n + row
            order = np.argsort(group, kind="stable")  # places stay in order
            group, at = group[order], at[order]
            begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])[: len(group)])
            first = order[begins]
            ends = np.concatenate([[0], np.cumsum(at >= 0)])[np.append(begins, len(group))]
            places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[at >= 0], pa.int32()))
            rows = pa.array(row[first])
            out = {"token": coded.dictionary.take(pa.array(alphabet[code[first]])), "field": named.take(pa.array(np.argsort(rank)[of[first] % len(named)])), "key": b.column("key").take(rows), "version": b.column("version").take(rows), "positions": places, "part": b.column("part").take(rows)}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


class Index:
    """The index of ``columns`` of records with a long ``key``, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str, columns: list[str]):
        self.spark, self.path, self.key, self.columns = spark, path, key, columns

    # what there is -------------------------------------------------------------------------------------------------------

    def _manifest(self) -> tuple[int, int, list[tuple[str, int]]]:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/_SUCCESS")
        if not target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return 0, 0, []
        last = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").orderBy(F.desc("sequence")).first()  # a row for each change
        return last.sequence, last.version, [(s.name, s.rows) for s in last.segments]

    def _commit(self, sequence: int, version: int, segments: list[tuple[str, int]]) -> None:
        self.spark.createDataFrame([(sequence, version, segments)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _read(self, what: str, schema: str, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(*[f"{self.path}/{what}/segment={n}" for n in names])
        return df.drop("segment")

    def _records(self, names: list[str]) -> DataFrame:
        """``key, version, deleted, len, part`` of all that the segments hold, outdated ones too."""
        rows = self._read("parts", POSTINGS, names).where(F.col("token") == "")
        return rows.select("key", "version", (F.size("positions") == 0).alias("deleted"), F.coalesce(F.get("positions", F.lit(0)), F.lit(0)).cast("long").alias("len"), "part")

    def _write(self, name: str, postings: DataFrame) -> None:
        """A segment's postings, dealt by part already."""
        postings.sortWithinPartitions("part", "token", "field", "key").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/parts/segment={name}")

    def _write_figures(self, name: str, frequencies: DataFrame, figures: DataFrame) -> None:
        frequencies.write.mode("overwrite").parquet(f"{self.path}/frequencies/segment={name}")
        figures.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/figures/segment={name}")

    # changes -------------------------------------------------------------------------------------------------------------

    def add(self, changes: DataFrame, version: int | None = None, updated: str | None = None, deleted: str | None = None) -> None:
        """A batch of changed records; of several rows of a key the one with the latest ``updated`` counts (ties, and without it: the largest values).

        Where the boolean ``deleted`` is true the record goes. ``version`` is the batch's number, from 1: one that is in the
        index already is passed over. Null keys are left out, null values are empty.
        """
        sequence, last, segments = self._manifest()
        version = last + 1 if version is None else version
        if version <= last:
            return
        ship(self.spark)
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        values = F.struct(gone.alias("deleted"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in self.columns])
        order = F.struct(F.col(updated).alias("at"), values.alias("v")) if updated else F.struct(values.alias("v"))
        rows = changes.where(F.col(self.key).isNotNull()).select(F.col(self.key).cast("long").alias("key"), order.alias("o"))
        # the one shuffle of texts: the newest row of a key is found, and its postings are made, where the part is
        part = F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int")
        newest = rows.withColumn("part", part).repartition("part").groupBy("part", "key").agg(F.max("o")["v"].alias("v"))
        plain = [F.when(F.col("v.deleted"), "").otherwise(text.normalise(F.col(f"v.{c}"))).alias(f"f{i}") for i, c in enumerate(self.columns)]
        name = f"s{version}"
        self._write(name, newest.select("key", F.lit(version).cast("long").alias("version"), "v.deleted", "part", *plain).mapInArrow(_postings(self.columns), POSTINGS))
        added = self._records([name])
        old, terms = self._outdated(added, [n for n, _ in segments])
        held = self._read("parts", HELD, [name]).where("token <> ''").select("token", "field", F.lit(1).alias("by")).unionByName(terms.withColumn("by", F.lit(-1)))
        frequencies = held.groupBy("token", "field").agg(F.sum("by").alias("n")).where("n <> 0")
        both = added.where("not deleted").select("len", F.lit(1).alias("by")).unionByName(old.select("len", F.lit(-1).alias("by")))
        figures = both.agg(F.coalesce(F.sum("by"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("by") * F.col("len")), F.lit(0)).alias("len"))
        self._write_figures(name, frequencies, figures)
        self._commit(sequence + 1, version, [*segments, (name, added.count())])
        self._merge()

    def _outdated(self, changes: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
        """``key, version, len`` of the records that a batch replaces, and ``token, field`` of each of their terms, from the parts in which its keys lie."""
        parts = [r.part for r in changes.select("part").distinct().collect()]  # PARTS at most
        there = self._records(names if parts else []).where(F.col("part").isin(*parts) if parts else F.lit(False))
        latest = there.join(changes.select("key"), "key", "left_semi").groupBy("key").agg(F.max(F.struct("version", "deleted", "len")).alias("x")).where("not x.deleted")
        old = stored(latest.select("key", "x.version", "x.len"), "outdated")
        n = old.count()
        held = self._read("parts", HELD, names if n else []).where("token <> ''").where(F.col("part").isin(*parts) if parts else F.lit(False))
        ids = old.select("key", "version")
        theirs = held.join(F.broadcast(ids), ["key", "version"], "left_semi") if n <= SENT else probably_in(held, F.col("key"), old, F.col("key")).join(ids, ["key", "version"], "left_semi")
        return old, theirs.select("token", "field")

    def _merge(self) -> None:
        """Merges the segments of a size, while there are FAN of them; each merge leaves one."""
        while True:
            sequence, version, segments = self._manifest()
            tiers: dict[int, list[tuple[str, int]]] = {}
            for s in segments:
                tiers.setdefault(int(math.log(max(1, s[1]), TIER)), []).append(s)
            full = next((t for _, t in sorted(tiers.items()) if len(t) >= FAN), None)
            if full is None:
                return
            names, name = [n for n, _ in full], f"m{sequence + 1}"
            newest = self._records([n for n, _ in segments]).groupBy("key").agg(F.max("version").alias("version"))
            own = self._records(names)
            out = own.join(newest, ["key", "version"], "left_anti").select("key", "version")
            if len(full) == len(segments):
                out = out.unionByName(own.where("deleted").select("key", "version")).distinct()  # nothing older is left that a deletion would have to hide
            out = stored(out, "outdated")
            rows = marked(self._read("parts", POSTINGS, names), F.col("key"), out, F.col("key"), "__old")
            kept = rows.where("not __old").unionByName(rows.where("__old").join(out, ["key", "version"], "left_anti")).drop("__old")
            frequencies = self._read("frequencies", FREQUENCIES, names).groupBy("token", "field").agg(F.sum("n").alias("n")).where("n <> 0")
            figures = self._read("figures", FIGURES, names).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("len"))
            self._write(name, kept.repartition("part"))
            self._write_figures(name, frequencies, figures)
            self._commit(sequence + 1, version, [*(s for s in segments if s not in full), (name, self._records([name]).count())])

    # search --------------------------------------------------------------------------------------------------------------

    def frequencies(self) -> DataFrame:
        """``token, field, n``: how many live records hold a token in a field."""
        _, _, segments = self._manifest()
        return self._read("frequencies", FREQUENCIES, [n for n, _ in segments]).groupBy("token", "field").agg(F.sum("n").alias("n")).where("n > 0")

    def records(self) -> DataFrame:
        """``key, version, len`` of the live records."""
        _, _, segments = self._manifest()
        rows = self._records([n for n, _ in segments])
        return rows.groupBy("key").agg(F.max(F.struct("version", "deleted", "len")).alias("x")).where("not x.deleted").select("key", "x.version", "x.len")

    def _hits(self, names: list[str], term: Term, weights: dict[str, float]) -> DataFrame:
        """``key, version, f``: weighed hits of a term, from the postings of its words alone."""
        fields = [c for c in weights if term.column in (None, c)]
        postings = self._read("parts", POSTINGS, names).where(F.col("field").isin(*fields))
        last = len(term.words) - 1
        found = None
        for i, w in enumerate(term.words):
            same = F.col("token").startswith(w) if term.prefix and i == last else F.col("token") == w
            at = postings.where(same).select("field", "key", "version", F.explode("positions").alias("p")).withColumn("p", F.col("p") - i)
            found = at if found is None else found.join(at.distinct(), ["field", "key", "version", "p"], "left_semi")
        weight: Column = F.coalesce(*[F.when(F.col("field") == c, F.lit(float(w))) for c, w in weights.items()])
        return found.groupBy("key", "version").agg(F.sum(weight).alias("f"))

    def ranked(self, weights: dict[str, float], terms: list[Term], limit: int = LIMIT) -> DataFrame:
        """The best live records that hold all terms: ``key`` (by its own name)``, score, rank``; the scores are those of ``search.ranked`` over the same records. Lower is better, ties go by key."""
        _, _, segments = self._manifest()
        names = [n for n, _ in segments]
        by_term = None
        for i, t in enumerate(terms):
            f = self._hits(names, t, weights).select("key", "version", *[(F.col("f") if j == i else F.lit(0.0)).alias(f"f{j}") for j in range(len(terms))])
            by_term = f if by_term is None else by_term.unionByName(f)
        hits = by_term.groupBy("key", "version").agg(*[F.sum(f"f{i}").alias(f"f{i}") for i in range(len(terms))])
        hits = stored(hits.join(self.records(), ["key", "version"]), "hits")
        s = hits.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(terms))]).first()  # one row of figures
        whole = self._read("figures", FIGURES, names).agg(F.sum("n").alias("n"), F.sum("len").alias("len")).first()
        n, average = whole.n or 0, (whole.len or 0) / whole.n if whole.n else 1.0
        score = F.lit(0.0)
        for i in range(len(terms)):
            idf = math.log((n - s[f"n{i}"] + 0.5) / (s[f"n{i}"] + 0.5))
            idf = idf if idf > 0 else 1e-6
            f = F.col(f"f{i}")
            score = score - F.lit(idf) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("len") / F.lit(average)))
        matched = hits.where(" and ".join(f"f{i} > 0" for i in range(len(terms))))
        top = matched.select(F.col("key").alias(self.key), round6(score).alias("score")).orderBy("score", self.key).limit(min(limit, MOST))
        return top.withColumn("rank", F.expr(f"row_number() over (order by score, {self.key})").cast("long"))
