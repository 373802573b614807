"""The prefix trie of conversations, by smallest-member ownership.

A node is a sequence of first turns; its members are the conversations that begin with it, its owner is the smallest of
them. Whoever owns a node owns all that follows on its own path, so each conversation owns a suffix of its path, which
one depth describes. A subtree's sum over nodes is then a sum over its members: what occurs on a member's path below, less
what the member owns there. One group-by on the prefix yields all figures of a node.

Prefixes are known by 128 bits: each turn at its place has two 64-bit hashes, and a prefix is the exclusive or of its
turns', so long conversations are run through in parts. Nothing reads the texts again once they are hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators import skew
from folioscope.operators.components import stored

NODE = ["depth", "p1", "p2"]
#: Ids that lie in one block of 2 ** BLOCK consecutive numbers are joined to one text before a node's texts meet.
BLOCK = 12
TURN = ["role", "content", "n_bytes"]


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place`` (from 1)``, role, content, n_bytes``: the turns of each conversation in order, texts as MD5 and their length in UTF-8.

    Turns are ordered by ``turn``, null first; ties by role, then by the MD5 of the text. A null role or text is empty. Equal
    rows are turns of their own. Rows without a conv_id belong to no conversation. Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    t = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.md5(text).alias("content"), F.octet_length(text).cast("long").alias("n_bytes"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("content")]
    return skew.running(skew.dealt(t, "conv_id", order), "conv_id", order, {"place": (F.count, F.lit(1), skew.added)}).select("conv_id", "place", *TURN)


def rebuilt(own: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of conversations that begin as the first of their family does: the first h turns of conversation c - c % ``family``, then c's own after its first h; h is crc32(decimal c) % ``heads``."""
    c = F.col("conv_id")
    head = F.crc32(c.cast("string").cast("binary")) % heads
    convs = stored(own.select("conv_id").distinct().withColumn("base", c - c % family).withColumn("head", head), "conversations")
    first = own.where((c % family == 0) & (F.col("place") < heads)).withColumnRenamed("conv_id", "base")
    begun = convs.join(first, "base").where("place <= head").select("conv_id", "place", *TURN)
    return begun.unionByName(own.where(F.col("place") > head)), convs.select("conv_id")


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id, depth, p1, p2, up1, up2`` (the prefix and that without its last turn)``, before`` (bytes of the turns before the last)``, role, n_bytes``: one row for each conversation and depth, from 0."""
    place = [F.col("place")]
    parts = skew.dealt(turns, "conv_id", place)
    at = skew.running(parts, "conv_id", place, {"depth": (F.count, F.lit(1), skew.added)})
    at = at.withColumn("z1", F.xxhash64("depth", "role", "content")).withColumn("z2", F.xxhash64("content", "depth", F.lit("/"), "role"))
    xor = lambda z: (F.bit_xor, F.col(z), skew.mixed)
    run = skew.running(at, "conv_id", place, {"p1": xor("z1"), "p2": xor("z2"), "bytes": (F.sum, F.col("n_bytes"), skew.added)})
    run = run.select("conv_id", "depth", "p1", "p2", F.col("p1").bitwiseXOR(F.col("z1")).alias("up1"), F.col("p2").bitwiseXOR(F.col("z2")).alias("up2"), (F.col("bytes") - F.col("n_bytes")).alias("before"), "role", "n_bytes")
    zero = [F.lit(0).cast("long").alias(k) for k in ("depth", "p1", "p2", "up1", "up2", "before")]
    return stored(run.unionByName(convs.select("conv_id", *zero, F.lit(None).cast("string").alias("role"), F.lit(0).cast("long").alias("n_bytes"))), "paths")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's texts, joined by commas, as they come in order; a node's texts are never held together."""
    key, state, done = None, None, []
    for b in batches:
        for *k, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if k != key:
                done += [] if state is None else [(*key, state.hexdigest())]
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield _batch(done)
        done = []
    yield _batch([] if state is None else [(*key, state.hexdigest())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [*zip(*rows, strict=True)] or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*NODE, "ends_sha256"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """``depth, p1, p2, ends_sha256`` of ``ends(conv_id, depth, p1, p2)``: SHA-256 of each node's ids, ascending, joined by commas. Blocks of ids become texts first, so a node with many has few rows."""
    blocks = ends.groupBy(*NODE, F.shiftright("conv_id", BLOCK).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    inorder = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids")
    return inorder.mapInArrow(_digests, "depth long, p1 long, p2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """The trie's nodes: ``conv_id`` (smallest member)``, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``, and ``node`` (hex of the prefix)``, role, n_bytes`` of its last turn.

    ``turns`` is what ``turns`` returns: conv_id, place, role, content, n_bytes, places unique within a conversation.
    ``convs(conv_id)`` names the conversations, those without turns too; by default those that have turns. n_leaves counts
    childless nodes of the subtree, its top included; saved_tokens sums (n_convs - 1) * n_bytes over it; ends_sha256 is of the
    members that end at the node. Without conversations there is no node.
    """
    path = paths(turns, turns.select("conv_id").distinct() if convs is None else convs)
    node = stored(path.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), *[F.min(c).alias(c) for c in ("up1", "up2", "before")]), "prefixes")
    ends = stored(path.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("x"), F.max(F.col("before") + F.col("n_bytes")).alias("total")).select("conv_id", "x.*", "total"), "ends")
    up = (F.col("depth") - 1).alias("depth"), F.col("up1").alias("p1"), F.col("up2").alias("p2")
    leaves = node.join(node.where("depth > 0").select(*up).distinct(), NODE, "left_anti")
    # the suffix each conversation owns: where it begins, what lies before it, and the owner of the node above
    own = stored(node.groupBy("conv_id").agg(F.min(F.struct("depth", "before", "up1", "up2")).alias("x")).select("conv_id", F.col("x.depth").alias("from"), F.col("x.before").alias("unowned"), F.col("x.up1").alias("up1"), F.col("x.up2").alias("up2")), "owned")
    above = skew.lookup(own.select("conv_id", (F.col("from") - 1).alias("depth"), F.col("up1").alias("p1"), F.col("up2").alias("p2")), node.select(*NODE, F.col("conv_id").alias("above")), NODE)
    conv = ends.select("conv_id", F.col("depth").alias("last"), "total").join(own.drop("up1", "up2"), "conv_id", "left").join(above.select("conv_id", "above"), "conv_id", "left")
    conv = stored(conv.join(leaves.select("conv_id", F.lit(1).alias("leaf")), "conv_id", "left"), "owners")
    seen = skew.lookup(path, conv, ["conv_id"])
    owned = F.col("depth") >= F.col("from")
    below = F.coalesce(((F.col("depth") + 1 >= F.col("from")) & (F.col("depth") < F.col("last"))).cast("long"), F.lit(0))
    parent = F.when(F.col("depth") > F.col("from"), F.col("conv_id")).when(owned, F.col("above"))
    # the bytes from this node to the end, less those the member owns there
    spare = F.greatest(F.lit(0), F.coalesce("unowned", "total") - F.col("before"))
    out = seen.groupBy(*NODE).agg(
        F.min(F.struct("conv_id", parent.alias("parent"))).alias("x"), F.count("*").alias("n_convs"), F.sum(below).alias("n_children"), F.sum(F.coalesce("leaf", F.lit(0)).cast("long")).alias("n_leaves"), F.sum(spare).alias("saved_tokens"), F.min("role").alias("role"), F.min("n_bytes").alias("n_bytes")
    )
    out = out.join(ends_digest(ends), NODE, "left")
    none = hashlib.sha256().hexdigest()
    node_id: Column = F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("p1", "p2")]))
    return out.select("x.conv_id", "depth", F.col("x.parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), node_id.alias("node"), "role", "n_bytes")


#: The nodes of ``conversations``, rebuilt as ``rebuilt`` does, in DuckDB: whole sequences as keys, every node with all its ancestors.
SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
             lambda s, b: list_reduce(list_concat([xor(s, b)], range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) % 9 AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h
      UNION ALL SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
l AS (SELECT c.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS turns FROM c LEFT JOIN r ON c.conv_id = r.conv_id GROUP BY 1),
o AS (SELECT conv_id, turns[1:d] AS path, d, len(turns) AS n FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM l)),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d) AS ends FROM o GROUP BY 1, 2),
k AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * coalesce(strlen(path[d].text), 0) AS spare FROM n LEFT JOIN k USING (path)),
up AS (SELECT path[1:a] AS path, sum(spare) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM m) GROUP BY 1)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(m.n_convs AS BIGINT) AS n_convs, CAST(m.n_children AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN up USING (path) LEFT JOIN n AS p ON m.d > 0 AND p.path = m.path[1:m.d - 1]
"""
