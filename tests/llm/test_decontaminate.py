import re
import tracemalloc

import numpy as np

from folioscope.llm import decontaminate as D
from folioscope.llm import queries


def tiled(item, doc, k):
    """``tile`` on the shared seeds of two texts, as the joins give them."""
    if min(len(item), len(doc)) < k:
        return np.zeros(len(item), bool)
    a, b = (D._places(D._seeds(x, k)) for x in (item, doc))
    shared = np.intersect1d(a[0], b[0])
    sides = [D._sequence(p.take(D.pa.array(np.searchsorted(s, shared)))) for s, p in (a, b)]
    return D.tile(len(item), k, *sides)


def brute(item, doc, k):
    marked, used = [False] * len(item), [False] * len(doc)
    while True:
        best = []
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not marked[i + n] and not used[j + n]:
                    n += 1
                if n >= k and (not best or n >= best[0][0]):
                    best = [x for x in best if x[0] == n] + [(n, i, j)]
        if not best:
            return marked
        for n, i, j in sorted(best):
            if not any(marked[i : i + n]) and not any(used[j : j + n]):
                marked[i : i + n] = [True] * n
                used[j : j + n] = [True] * n


def test_tiles_equal_the_plain_algorithm():
    rng = np.random.default_rng(5)
    for _ in range(150):
        item, doc = (rng.integers(0, 4, n).astype(np.uint64) for n in rng.integers(0, 25, 2))
        k = int(rng.integers(2, 5))
        assert tiled(item, doc, k).tolist() == brute(item.tolist(), doc.tolist(), k)


def test_repetitive_texts_need_memory_in_proportion():
    one, many = np.zeros(200, np.uint64), np.zeros(1_000_000, np.uint64)
    tracemalloc.start()
    assert tiled(one, many, 5).all()
    assert tiled(many[:20_000], many, 5).all()
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()


def test_reordered_passages_and_edge_cases(spark):
    item = " ".join(f"w{i}" for i in range(20))
    w = item.split()
    bench = spark.createDataFrame([(7, item), (3, item), (8, None), (9, ""), (10, "two words")], "item_id long, text string")
    rows = [(1, "x y " + ", ".join(w) + "! z"), (2, " ".join(w[10:] + ["mid"] + w[:10]).upper()), (3, " ".join(w[:10])), (4, "clean text of nothing"), (5, None), (6, ""), (7, "has Two words here"), (None, item), (1, "x y " + item + " z"), (8, "lorem ipsum " * 200_000 + item)]
    clash = "k int, n_words int, seed int, at int, t1 int, t2 int, item int, met int, share double, n_items string"
    docs = spark.createDataFrame([(i, *r, 1, 2, 3, 4, 5, 6, 7, 8, 0.5, "x") for i, r in enumerate(rows)], "nth int, doc_id long, text string, " + clash)
    for bits in (D.BITS, 1 << 15):  # a full bitmap only moves more
        D.BITS, keep = bits, D.BITS
        try:
            found = sorted(D.contamination(docs, bench).collect())
        finally:
            D.BITS = keep
        assert all(tuple(r)[3:12] == (1, 2, 3, 4, 5, 6, 7, 8, 0.5) for r in found)
        got = [tuple(r)[12:] for r in found]
        assert got[0] == (2, 3, 1.0, True) == got[1] == got[7] == got[8] == got[9]
        assert got[2] == (2, 3, 0.5, False)
        assert got[3] == got[4] == got[5] == (0, None, 0.0, False)
        assert got[6] == (1, 10, 1.0, True)
    assert D.contamination(docs.limit(0), bench).count() == 0
    assert D.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_query_equals_brute_force(spark, sf):
    got = {r.doc_id: r for r in queries.op5_decontamination(spark, sf).collect()}
    read = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    words = lambda t: re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t.translate({i: i + 32 for i in range(65, 91)}))
    items = [(r.item_id, words(r.text)) for r in read("benchmark").collect()]
    seeds = {}
    for i, w in items:
        for s in zip(*(w[n:] for n in range(5)), strict=False):
            seeds.setdefault(s, set()).add(i)
    met = 0
    for r in read("documents").collect():
        w = words(r.text or "")
        near = set().union(*(seeds.get(s, ()) for s in zip(*(w[n:] for n in range(5)), strict=False)))
        shares = {i: float(np.mean(tiled(*(np.array([hash(x) & (1 << 60) - 1 for x in y], np.uint64) for y in (v, w)), 5))) for i, v in items if i in near}
        best = min(((-s, i) for i, s in shares.items()), default=(0.0, None))
        g = got[r.doc_id]
        assert (g.n_items, g.best_item, g.best_coverage, g.contaminated) == (len(shares), best[1], -best[0], -best[0] >= 0.8)
        met += bool(shares)
    assert len(got) == read("documents").count() and met
