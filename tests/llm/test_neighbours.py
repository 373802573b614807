import numpy as np

from folioscope.llm import neighbours, queries


def brute(rows, threshold):
    ok = [i for i, (d, e, lab) in enumerate(rows) if d is not None and lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in ok}
    linked = {i: {j for j in ok if rows[j][2] == rows[i][2] and len(rows[j][1]) == len(rows[i][1]) and unit[i] @ unit[j] >= threshold} for i in ok}
    out = []
    for i, (d, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = linked.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        out.append((d, len({rows[j][0] for j in linked.get(i, ())} - {d}), min(rows[j][0] for j in seen) if d is not None else None))
    return out


key = lambda r: tuple((x is None, x or 0) for x in r)


def test_equals_brute_force_and_edge_cases(spark):
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1):
        x = rng.standard_normal((150, 16))
        x[100:120] = x[0] + 0.15 * rng.standard_normal((20, 16))  # a group larger than a list
        x[130:135] = x[5]
        x[140] = 3 * x[6]
        rows += [(len(rows) + i, [float(a) for a in r], label) for i, r in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 16, 0), (n + 3, [None] * 16, 0), (n + 4, [float("nan")] * 16, 0), (n + 5, [float("inf")] + [1.0] * 15, 0), (n + 6, rows[0][1], None), (None, rows[0][1], 0), (n + 7, [1.0, 2.0], 0), (n + 8, [1e300, 2e300], 0), rows[9], rows[5]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = neighbours.near_duplicates(frame).collect()
    want = brute([(d, [x / 1e290 for x in e] if e and e[0] == 1e300 else e, lab) for d, e, lab in rows], 0.93)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    assert neighbours.near_duplicates(frame.limit(0)).count() == 0


def test_lists_are_enlarged_until_they_are_not_full(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 32))
    x[100:130] = x[0] + 0.1 * rng.standard_normal((30, 32))  # more links than a list has places
    x[200:330] = x[1] + 0.1 * rng.standard_normal((130, 32))  # more than the widest
    rows = [(i, r.tolist(), 0) for i, r in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    v = neighbours.stored(neighbours.nodes(frame), "vectors")
    lists, full = neighbours._enlarged(*neighbours._descent(v, 400, 0.93))
    first = {r.node: r.first_id for r in v.collect()}
    assert {first[r.node] for r in full.collect()} == {1, *range(200, 330)}
    near = {first[r.a]: r["count"] for r in lists.where("sim >= 0.93").groupBy("a").count().collect()}
    assert min(near[i] for i in (0, *range(100, 130))) >= 28, near
    block, neighbours.BLOCK = neighbours.BLOCK, 64
    try:
        got = neighbours.near_duplicates(frame).collect()
    finally:
        neighbours.BLOCK = block
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(brute(rows, 0.93), key=key)


def test_recall_on_the_whole_table_at_a_threshold_with_links(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumn("label", neighbours.F.lit(1))
    rows = [(r.vec_id, [float(x) for x in r.embedding], 1) for r in frame.collect()]
    unit = np.array([e for _, e, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.93
    want = {d: int(n) - 1 for (d, _, _), n in zip(rows, hit.sum(1), strict=True)}
    got = {r.vec_id: r.n_links for r in neighbours.near_duplicates(frame).collect()}
    assert all(got[d] <= n for d, n in want.items()) and sum(got.values()) >= 0.95 * sum(want.values())
    assert queries.op9_embedding_near_dedup(spark, "/root/testdata/sf0.01").count() == 500
    print("links", sum(want.values()))


def test_a_large_label_with_few_links_is_searched_whole(spark):
    rng = np.random.default_rng(11)
    n, pairs, dims = 8000, 150, 64
    x = rng.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(pairs):
        y = rng.standard_normal(dims)
        y -= (y @ x[i]) * x[i]
        x[n - 1 - i] = 0.932 * x[i] + (1 - 0.932**2) ** 0.5 * y / np.linalg.norm(y)
    frame = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in neighbours.near_duplicates(frame).collect()}
    assert all(got[i].n_links == 1 and got[n - 1 - i].component_id == i for i in range(pairs))
    assert sum(r.n_links for r in got.values()) == 2 * pairs
    assert [neighbours.n_trees(b, 0.93) for b in (0, 5, 15, 20)] == [8, 8, 38, 74]


def test_the_audit_stays_as_small_as_it_is_on_a_large_table(spark, monkeypatch, caplog):
    seen, real = [], neighbours.searched
    monkeypatch.setattr(neighbours, "searched", lambda asked, v, threshold, every=False: (seen.append((every, asked.count())), real(asked, v, threshold, every))[1])
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    with caplog.at_level("INFO", logger=neighbours.__name__):
        neighbours.near_duplicates(frame).count()
    assert [every for every, _ in seen] == [True, False] and 0 < seen[0][1] <= neighbours.AUDIT and seen[1][1] == 0
    assert "sampled vectors" in caplog.text
