"""Removal of long repeated strings, by prefix-free parsing with rolling-hash triggers.

A rolling hash over GRAM bytes picks triggers: of each string of LENGTH bytes, the gram with the smallest hash. Equal
strings have their trigger at the same place, so a trigger cuts the text into phrases that begin and end alike wherever
the same text stands. The distinct phrases, each with all strings of which its trigger is the smallest gram, are the
dictionary; the phrase numbers of the texts are the parse. Repeats are settled on the dictionary: a phrase that occurs
twice is repeated as a whole; phrases that share a trigger but differ are compared by their strings, once for each
distinct phrase however often it occurs. The full suffix order of the corpus is never written out: only equality at one
length is asked for, and the order of all suffixes would be some 25 times the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import kernels as K
from folioscope.operators.components import stored
from folioscope.operators.prefilter import probably_in
from folioscope.operators.ship import ship

LENGTH, GRAM = 200, 32
#: Phrases that one task settles together; a trigger that leads more of them is settled string by string across tasks.
CROWD = 20_000


def phrases(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each phrase: its text's number, its trigger's place, its first and last string's start, and hashes of trigger and phrase."""
    n, none = len(data), np.zeros(0, np.int64)
    sizes = np.diff(at)
    long = np.flatnonzero(sizes >= length)
    if not len(long):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = K.prefix_hash(data)
    place = np.arange(n - gram + 1)
    g = K.range_hash(prefix, place, place + gram)
    w = length - gram + 1
    key = g >> np.uint64(32) << np.uint64(32) | place.astype(np.uint64)
    pad = -len(key) % w
    key = np.concatenate((key, np.full(pad, ~np.uint64(0)))).reshape(-1, w)
    ahead = np.minimum.accumulate(key, 1).ravel()
    behind = np.minimum.accumulate(key[:, ::-1], 1)[:, ::-1].ravel()
    starts = np.repeat(at[:-1][long] - np.concatenate(([0], np.cumsum(sizes[long] - length + 1)))[:-1], sizes[long] - length + 1) + np.arange((sizes[long] - length + 1).sum())
    trigger = (np.minimum(behind[starts], ahead[starts + w - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], np.diff(trigger) != 0)))
    lo, hi = starts[begin], starts[np.concatenate((begin[1:], [len(starts)])) - 1]
    t = trigger[begin]
    whole = K.mix(K.range_hash(prefix, lo, hi + length) + (t - lo).astype(np.uint64) * K.FAMILY_A[0])
    return np.searchsorted(at, t, "right") - 1, t, lo, hi, g[t], whole


def parse(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``docs(k1, k2, text)`` to one row for each phrase: ``trigger, phrase, k1, k2, pos, lo, hi``, places within the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in K.chunks(batches):
            doc, t, lo, hi, trigger, phrase = phrases(data, at, length, gram)
            base = at[doc]
            keys = [rows.column(c).to_numpy(zero_copy_only=False)[doc] for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([K.long_column(trigger), K.long_column(phrase), *map(pa.array, keys), *(pa.array((x - base).astype(np.int32)) for x in (t, lo, hi))], names=["trigger", "phrase", "k1", "k2", "pos", "lo", "hi"])

    return docs.select("k1", "k2", "text").mapInArrow(run, "trigger long, phrase long, k1 long, k2 long, pos int, lo int, hi int")


def _bodies(texts: DataFrame, length: int) -> DataFrame:
    """``texts(text, wanted)`` to one row for each wanted phrase: its bytes and how far its trigger is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in K.chunks(batches):
            wanted = rows.column(1)
            flat, count = wanted.flatten(), np.diff(wanted.offsets.to_numpy())
            lo, hi, pos = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("lo", "hi", "pos"))
            base = np.repeat(at[:-1], count)
            body = [data[i:j].tobytes() for i, j in zip((base + lo).tolist(), (base + hi + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([flat.field("trigger"), flat.field("phrase"), flat.field("m"), pa.array(pos - lo), pa.array(body, pa.binary())], names=["trigger", "phrase", "m", "lead", "body"])

    return texts.select("text", "wanted").mapInArrow(run, "trigger long, phrase long, m long, lead int, body binary")


def _strings(trigger: np.ndarray, lead: np.ndarray, bodies: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all strings of the phrases: whose, how far before (-) or after the trigger they start, and a hash of trigger, place and bytes."""
    at = np.frombuffer(bodies.buffers()[1], np.int32 if pa.types.is_binary(bodies.type) else np.int64)[bodies.offset : bodies.offset + len(bodies) + 1].astype(np.int64)
    data = np.frombuffer(bodies.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    n = np.diff(at) - length + 1
    each = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    h = K.range_hash(K.prefix_hash(data), at[each] + start, at[each] + start + length)
    offset = start - lead[each]
    return each, offset, K.mix(h + trigger.view(np.uint64)[each] * np.uint64(3) + offset.astype(np.int64).view(np.uint64) * K.FAMILY_A[1])


def _settled(bodies: DataFrame, length: int, n: int) -> DataFrame:
    """``trigger, phrase, lo, hi``: first and last repeated string of each phrase, for phrases whose trigger leads at most CROWD of them.

    All strings of a phrase hold its trigger, so what they cover is one piece from the first to the end of the last."""

    def resolve(t: pa.Table) -> pa.Table:
        trigger, phrase, lead = (t.column(c).to_numpy() for c in ("trigger", "phrase", "lead"))
        each, offset, h = _strings(trigger, lead, t.column("body").combine_chunks(), length)
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        again = np.zeros(len(h), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        who, off = each[again], offset[again]
        first = np.flatnonzero(np.concatenate(([True], np.diff(who) != 0))) if len(who) else np.zeros(0, np.int64)
        last = np.concatenate((first[1:], [len(who)]))[: len(first)] - 1
        return pa.table({"trigger": pa.array(trigger[who[first]]), "phrase": pa.array(phrase[who[first]]), "lo": pa.array(off[first].astype(np.int32)), "hi": pa.array(off[last].astype(np.int32))})

    bins = F.pmod(F.xxhash64("trigger"), F.lit(max(1, n // CROWD)))
    return bodies.withColumn("bin", bins).groupBy("bin").applyInArrow(resolve, "trigger long, phrase long, lo int, hi int")


def _settled_apart(bodies: DataFrame, length: int) -> DataFrame:
    """The same for crowded triggers, one row for each string, so that no task holds all phrases of a trigger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                rows = b.slice(i, 2000)
                trigger, phrase, lead = (rows.column(rows.schema.get_field_index(c)).to_numpy() for c in ("trigger", "phrase", "lead"))
                each, offset, h = _strings(trigger, lead, rows.column(rows.schema.get_field_index("body")), length)
                yield pa.RecordBatch.from_arrays([K.long_column(h), pa.array(trigger[each]), pa.array(phrase[each]), pa.array(offset.astype(np.int32))], names=["string", "trigger", "phrase", "offset"])

    strings = bodies.mapInArrow(run, "string long, trigger long, phrase long, offset int")
    same = ["trigger", "offset", "string"]  # two hashes and a place, so that no two of a great many strings are taken for one
    twice = strings.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1").select(*same)
    return strings.join(twice, same).groupBy("trigger", "phrase").agg(F.min("offset").alias("lo"), F.max("offset").alias("hi"))


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int | None = None) -> DataFrame:
    """``keyed(k1, k2, text)`` to ``k1, k2, spans``: for each text with repeats, pieces (first, last start) of its repeated strings."""
    ship(keyed.sparkSession)
    crowd = CROWD if crowd is None else crowd
    parsed = parse(keyed, length, gram)
    common = parsed.groupBy("trigger").agg(F.count("*").alias("n")).where("n > 1").select("trigger")
    common = stored(common, "triggers")
    found = stored(probably_in(parsed, F.col("trigger"), common, F.col("trigger"), 1 << 26).join(common, "trigger"), "phrases")
    entry = found.groupBy("trigger", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "pos", "lo", "hi")).alias("at"))
    entry = stored(entry, "dictionary")
    unlike = entry.groupBy("trigger").agg(F.count("*").alias("m")).where("m > 1")
    edges = entry.join(unlike, "trigger").select("at.k1", "at.k2", F.struct("trigger", "phrase", "m", "at.pos", "at.lo", "at.hi").alias("wanted"))
    edges = stored(edges.groupBy("k1", "k2").agg(F.collect_set("wanted").alias("wanted")), "edges")
    texts = probably_in(keyed, F.col("k1"), edges, F.col("k1")).join(edges, ["k1", "k2"])
    bodies = stored(_bodies(texts, length), "bodies")
    bodies = bodies.dropDuplicates(["trigger", "phrase"])  # rows that repeat a document
    some, many = bodies.where(F.col("m") <= crowd), bodies.where(F.col("m") > crowd)
    parts = _settled(some, length, entry.count()).union(_settled_apart(many, length))
    whole = entry.where("n > 1").select("trigger", "phrase", F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))
    single = entry.where("n = 1").select("trigger", "phrase").join(parts, ["trigger", "phrase"])
    settled = whole.union(single).select("trigger", "phrase", F.col("lo").alias("from"), F.col("hi").alias("to"))
    span = F.struct(F.coalesce(F.col("pos") + F.col("from"), "lo").alias("lo"), F.coalesce(F.col("pos") + F.col("to"), "hi").alias("hi"))
    return found.join(settled, ["trigger", "phrase"]).groupBy("k1", "k2").agg(F.array_sort(F.collect_set(span)).alias("spans"))


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with its text, null as empty, as ``text``, and a 128-bit key of doc_id and text."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rest = [F.col(c) for c in docs.columns if c not in (text, "kept", "n_bytes", "n_removed", "n_spans")]
    return docs.select(*rest, F.xxhash64(F.lit(5), "doc_id", body).alias("__k1"), F.xxhash64("doc_id", F.lit(7), body).alias("__k2"), body.alias("__text"))


def _cut(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """``__k1, __k2, kept, n_removed, n_spans`` of the texts that lose something."""
    slim = keyed.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col("__text").alias("text"))
    spans = stored(repeated_spans(slim, length, gram), "spans")
    touched = probably_in(slim, F.col("k1"), spans, F.col("k1")).join(spans, ["k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in K.chunks(batches):
            kept, removed, runs = [], [], []
            column = rows.column(3)
            flat, first = column.flatten(), column.offsets.to_numpy()
            lo, hi = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("lo", "hi"))
            first = first - first[0]
            for d in range(rows.num_rows):
                mark = np.zeros(at[d + 1] - at[d] + 1, np.int32)
                j = slice(first[d], first[d + 1])
                np.add.at(mark, lo[j], 1)
                np.add.at(mark, hi[j] + length, -1)
                gone = np.cumsum(mark)[:-1] > 0
                kept.append(data[at[d] : at[d + 1]][~gone].tobytes())
                removed.append(int(gone.sum()))
                runs.append(int(gone[0]) + int((np.diff(gone.astype(np.int8)) == 1).sum()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], names=["__k1", "__k2", "kept", "n_removed", "n_spans"])

    return touched.select("k1", "k2", "text", "spans").mapInArrow(run, "__k1 long, __k2 long, kept binary, n_removed long, n_spans long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` replaced by ``kept`` (binary), ``n_bytes``, ``n_removed`` and ``n_spans``.

    Every byte covered by a string of ``length`` UTF-8 bytes that also starts elsewhere, in any row or the same, goes;
    all strings are judged on the input, and matches never cross texts. A null text is empty; texts under ``length``
    bytes stay. Rows that agree in all of doc_id and text are repeats of each other like any other rows. The remaining
    bytes need not be valid UTF-8. Equality is that of two 64-bit hashes, of trigger and phrase or string. Columns of
    the same names are replaced, all others kept.
    """
    keyed = _keyed(docs, text)
    out = keyed.join(_cut(keyed, length, gram).dropDuplicates(["__k1", "__k2"]), ["__k1", "__k2"], "left")
    return out.select(*keyed.columns[:-3], F.coalesce("kept", F.col("__text").cast("binary")).alias("kept"), F.octet_length("__text").cast("long").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"))


def digest(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``; texts are digested before the join, so those without repeats are not moved.

    A null text is an empty one: 0 bytes and the digest of nothing. Rows that agree in doc_id and text are
    repeats of each other like any other rows; a null doc_id stays null. Very long texts are cut into phrases where they are read, none is left out. An
    empty table gives no rows.
    """
    keyed = _keyed(docs.select("doc_id", "text"), "text")
    cut = _cut(keyed, length, gram).select("__k1", "__k2", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")).dropDuplicates(["__k1", "__k2"])
    every = keyed.select("doc_id", "__k1", "__k2", F.octet_length("__text").cast("long").alias("n_bytes"), F.sha2(F.col("__text").cast("binary"), 256).alias("all_sha"))
    out = every.join(cut, ["__k1", "__k2"], "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("sha", "all_sha").alias("kept_sha256"))
