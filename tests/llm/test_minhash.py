import random

from folioscope.llm import minhash


def brute(rows, k, percent):
    """component by doc_id and set size by row, comparing all pairs."""
    def words(t):
        return [w for w in (t or "").translate({i: i + 32 for i in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\v", " ").split(" ") if w]

    def shingles(t):
        w = words(t)
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [(d, shingles(t)) for d, t in rows]
    up = {d: d for d, _ in rows if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, r in sets[:i]:
            if d is not None and e is not None and s and r and 100 * len(s & r) >= percent * len(s | r):
                a, b = sorted((root(d), root(e)))
                up[b] = a
    return [(d, len(s), root(d) if d is not None else None) for d, s in sets]


def same(spark, rows, k, percent):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_shingles int")
    got = minhash.near_duplicates(docs, k, percent).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute(rows, k, percent), key=key)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_planted_groups_and_edge_cases(spark):
    rnd = random.Random(3)
    fresh = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    rows, n = [], 0
    for _ in range(6):
        base = fresh(200)
        for edits in (0, 0, 1, 2, 3, 5, 8, 12, 30):
            w = list(base)
            for _ in range(edits):
                w[rnd.randrange(len(w))] = "new" + str(rnd.randrange(10**6))
            rows.append((n, " ".join(w)))
            n += 1
    hub = fresh(300)
    for _ in range(60):  # copies of one hub, each further from the others than the threshold
        w = list(hub)
        for i in rnd.sample(range(300), 7):
            w[i] = f"x{rnd.randrange(10**6)}"
        rows.append((n, " ".join(w)))
        n += 1
    rows += [(n, " ".join(hub)), (n + 1, None), (n + 2, ""), (n + 3, " \n\t"), (n + 4, "One two"), (n + 5, "one\vTWO"), (n + 6, "one"), (None, "one two"), (0, rows[0][1]), (5, "one two"), (n + 7, "a " * 4000), (n + 8, "a a a")]
    same(spark, rows, 3, 85)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).count() == 0
