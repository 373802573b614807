import math
import random

import pytest

from folioscope.llm import negatives, queries
from tests.compare import compared

SCHEMA = "vec_id long, embedding array<double>, label int, q1 string, list int"


def brute(rows, every=100):
    usable = {}
    for i, e, label, *_ in rows:
        if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            v = tuple(math.floor(256 * x) for x in e)
            if sum(x * x for x in v) < 1 << 55:
                usable[i, label, v] = 1
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    out = []
    for a, la, va in usable:
        if a % every:
            continue
        others = sorted((-dot(va, v), i, label) for i, label, v in usable if i != a)
        for s, p, _ in [x for x in others if x[2] == la][:5]:
            fit = [x for x in others if x[2] != la and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **more):
    return sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), **more).collect()))


def made(n, dims, seed, hot=0):
    random.seed(seed)
    centres = [[random.gauss(0, 1) for _ in range(dims)] for _ in range(7)]
    rows = [(i, [0.5] * dims if hot and i % hot == 0 else [c + random.gauss(0, 0.2) for c in random.choice(centres)], random.randrange(4), "x", 1) for i in range(n)]
    return rows


def test_hot_equal_vectors_ties_and_odd_rows(spark):
    rows = made(900, 3, 1, hot=3)
    rows += [(2000, None, 1, "", 0), (2100, [1.0, None, 0.0], 1, "", 0), (2200, [math.nan, 0.0, 0.0], 1, "", 0), (2300, [math.inf, 0.0, 0.0], 2, "", 0), (2400, [0.1, 0.2, 0.3], None, "", 0), (None, [0.5, 0.5, 0.5], 1, "", 0)]
    rows += [(2500, [0.0, 0.0, 0.0], 1, "", 0), (2600, [0.9, 0.9], 1, "", 0), (2700, [], 2, "", 0), (2800, [1e300, 0.0, 0.0], 1, "", 0), (2900, [1e5, 1e5, 0.0], 1, "", 0), (2901, [9e4, 9e4, 1.0], 1, "", 0), (2902, [8e4, 9e4, 1.0], 2, "", 0)]
    rows += rows[:40] + [(100, [0.4, 0.5, 0.6], 3, "", 0), (100, [0.4, 0.5, 0.6], 2, "", 0), (-100, [-1.0, 0.5, 0.0], 2, "", 0)]
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 100
    assert mined(spark, [r for r in rows if r[1] is None]) == []


@pytest.mark.parametrize("small", [True, False])
def test_many_lists_blocks_and_waves(spark, monkeypatch, small):
    if small:  # several blocks in a list, several chunks of visitors, several bins
        monkeypatch.setattr(negatives, "BLOCK", 16)
        monkeypatch.setattr(negatives, "CHUNK", 4)
        monkeypatch.setattr(negatives, "BIN", 500)
        monkeypatch.setattr(negatives, "FIRST", 1)
    rows = made(700, 6, 2)
    got = mined(spark, rows, every=10)
    assert got == brute(rows, 10) and len(got) > 300


def test_lists_out_of_reach_are_skipped(spark):
    """Far groups: most lists are never visited."""
    import numpy as np
    import pyarrow as pa

    random.seed(4)
    rows = [(i, [20.0 * math.cos(i % 12) + random.gauss(0, 0.01), 20.0 * math.sin(i % 12) + random.gauss(0, 0.01)], i % 3, "", 0) for i in range(600)]
    table = negatives.prepared(spark.createDataFrame(rows, SCHEMA))
    index = negatives.Index(table, 2, table.count())
    q = np.array(table.where("vec_id = 0").first().v)
    batch = pa.RecordBatch.from_pylist([{"q1": 0, "q2": 0, "label": 0, "v": q.tolist(), "lo": [int(q @ q * 0.99)], "hi": [int(q @ q * 1.01)], "kth": [negatives.LOW]}])
    (found,) = index._to_visit(0, 1000)(iter([batch]))
    assert 0 < len(found.column("lists")[0].as_py()) < len(index.numbers) / 3
    assert {int(n) for n in index.numbers} == {r["list"] for r in index.members.select("list").distinct().collect()}


def test_sql_agrees(spark, sf):
    compared(spark, sf, "op11", queries.op11_hard_negative_mining, negatives.SQL)
