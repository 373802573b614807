import hashlib
import random
from collections import Counter

from folioscope.llm import queries, repeats


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


key = lambda r: (r[0] is None, *[x or 0 for x in r[:1]], r[1:])


def test_equals_brute_force_and_edge_cases(spark):
    rnd = random.Random(8)
    fresh = lambda n: "".join(rnd.choice("abcdefé \n") for _ in range(n))
    shared = [fresh(n) for n in (30, 60, 90, 150)]
    rows = [(i, fresh(rnd.randrange(80)) + rnd.choice(shared)[rnd.randrange(20) :] + fresh(rnd.randrange(80)) + rnd.choice(shared)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "x" * 500), (103, "ab" * 300), (104, "short"), (105, fresh(4000)), (None, rows[3][1]), (7, rows[7][1]), (106, "y" * 40), (107, fresh(39)), (108, fresh(300) + "y" * 41)]
    docs = spark.createDataFrame([(d, t, 3, "k") for d, t in rows], "doc_id long, text string, n_spans int, k1 string")
    for length, gram in ((40, 8), (57, 20)):
        got = sorted((tuple(r) for r in repeats.digest(docs, length, gram).collect()), key=key)
        assert got == sorted(brute(rows, length), key=key)
    keep, repeats.CROWD = repeats.CROWD, 2  # most triggers count as crowded
    crowded = sorted((tuple(r) for r in repeats.digest(docs, 40, 8).collect()), key=key)
    repeats.CROWD = keep
    assert crowded == sorted(brute(rows, 40), key=key)
    full = repeats.remove_repeats(docs, 40, 8)
    assert full.columns == ["doc_id", "k1", "kept", "n_bytes", "n_removed", "n_spans"]
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in full.collect()), key=key) == sorted(brute(rows, 40), key=key)
    assert repeats.digest(docs.limit(0)).count() == 0


def test_whole_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op7_suffix_array_dedup(spark, sf).collect())
    assert got == sorted(brute(rows, 200)) and any(r[2] for r in got)
