import random

from folioscope.operators import clusters

FIELDS, NAMING = ["codes", "registers", "records"], ["codes", "registers"]
SCHEMA = "id long, codes array<string>, registers array<string>, records array<string>, weak string"


def sequential(rows):
    """Albums in order of arrival: joined to every group with a shared value and no clash, else by title and performer to the only group that fits."""
    groups = []
    clash = lambda a, b: any(a[f] and b[f] and not a[f] & b[f] for f in FIELDS)
    is_named = lambda g: any(g[f] for f in NAMING)
    for r in rows:
        new = {"ids": {r[0]}, "weak": {r[4]} - {None}} | {f: set(v or []) for f, v in zip(FIELDS, r[1:4], strict=True)}

        def take(g, new=new):
            for k in new:
                new[k] |= g[k]
            groups.remove(g)

        for g in list(groups):
            if not clash(new, g) and any(new[f] & g[f] for f in FIELDS):
                take(g)
        fits = [g for g in groups if not clash(new, g) and new["weak"] & g["weak"] and not (is_named(new) and is_named(g))]
        if len(fits) == 1:
            take(fits[0])
        groups.append(new)
    return {i: min(g["ids"]) for g in groups for i in g["ids"]}


def run(spark, rows):
    got = clusters.agreeing(spark.createDataFrame(rows, SCHEMA), FIELDS, NAMING, "weak").collect()
    assert len(got) == len(rows)
    return {r.id: r.cluster for r in got}


PLANTED = {
    "two editions of one title stay apart": [(1, ["c1"], ["u1"], None, "t"), (2, ["c2"], ["u2"], None, "t")],
    "a cover that serves two editions joins none": [(1, ["c1"], ["u1"], None, "t"), (2, ["c2"], ["u2"], None, "t"), (3, ["c1"], ["u1"], None, "t"), (4, None, None, None, "t")],
    "a cover that serves one joins it": [(1, ["c1"], ["u1"], None, "t"), (2, None, None, None, "t"), (3, None, None, None, "t")],
    "registers that differ": [(1, None, ["u1"], None, "t"), (2, None, ["u2"], None, "t")],
    "one register, two codes": [(1, ["c1"], ["u1"], None, None), (2, ["c2"], ["u1"], None, None), (3, None, ["u1"], None, None)],
    "a record joins what two fields name": [(1, ["c1"], None, ["f1"], None), (2, None, ["u1"], ["f1"], None), (3, ["c1"], ["u1"], None, None), (4, ["c2"], ["u1"], None, None)],
    "covers without anything": [(1, None, None, None, "t"), (2, [], None, None, "t"), (3, None, None, None, None), (4, [""], [None], None, "")],
    "a chain of codes": [(i, [f"c{i}", f"c{i + 1}"], None, None, None) for i in range(1, 40)] + [(50, ["c1"], ["u1"], None, None), (51, ["c30"], ["u1"], None, None), (52, ["c20"], ["u2"], None, None)],
    "a record without a name finds its only album": [(1, ["c1"], None, None, "t"), (2, None, None, ["f1"], "t"), (3, None, None, None, "t")],
    "records that differ": [(1, ["c1"], None, ["f1"], "t"), (2, None, None, ["f2"], "t")],
    "hosts take no two guests that clash": [(1, None, ["u1"], None, None), (2, ["c1"], ["u1"], None, None), (3, ["c2"], ["u1"], None, None), (4, ["c1"], ["u1"], ["f1"], None), (5, ["c1"], None, ["f2"], None)],
}


def test_planted_conflicts_equal_the_sequential_rule(spark):
    """All cases in one run, each with values of its own."""
    rows, want = [], {}
    for k, case in enumerate(PLANTED.values()):
        own = lambda v, k=k: v and [x and f"{k}/{x}" for x in v]
        rows += [(1000 * k + i, own(c), own(u), own(f), w and f"{k}/{w}") for i, c, u, f, w in case]
        want |= {1000 * k + i: 1000 * k + j for i, j in sequential(case).items()}
    found = run(spark, rows)
    assert {name: {i: found[i] for i in found if i // 1000 == k} for k, name in enumerate(PLANTED)} == {name: {i: want[i] for i in want if i // 1000 == k} for k, name in enumerate(PLANTED)}


def test_no_clash_in_a_cluster_and_none_left_that_agree(spark):
    random.seed(1)
    pick = lambda k, n: [f"{k}{random.randrange(n)}"] if random.random() < 0.5 else None
    rows = [(i, pick("c", 24), pick("u", 19), pick("f", 18), None) for i in range(320)]
    found = run(spark, rows)
    groups = {}
    for r in rows:
        g = groups.setdefault(found[r[0]], {f: set() for f in FIELDS} | {"ids": []})
        g["ids"].append(r[0])
        for f, v in zip(FIELDS, r[1:4], strict=True):
            g[f] |= set(v or [])
    assert all(min(g["ids"]) == k and all(len(g[f]) <= 1 for f in FIELDS) for k, g in groups.items())
    values = list(groups.values())
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            shared = any(a[f] & b[f] for f in FIELDS)
            assert not (shared and all(not a[f] or not b[f] or a[f] & b[f] for f in FIELDS)), (a, b)


def test_one_block_with_a_hot_album(spark):
    n = 60_000
    rows = spark.range(n).selectExpr("id", "array(if(id % 3 = 0, 'hot', concat('c', id div 4))) as codes", "cast(null as array<string>) as registers", "cast(null as array<string>) as records", "'t' as weak")
    got = clusters.agreeing(rows, FIELDS, NAMING, "weak")
    want = {}
    for i in range(n):
        want.setdefault("hot" if i % 3 == 0 else i // 4, i)
    assert {(r.id, r.cluster) for r in got.collect()} == {(i, want["hot" if i % 3 == 0 else i // 4]) for i in range(n)}


def test_empty(spark):
    assert clusters.agreeing(spark.createDataFrame([], SCHEMA), FIELDS, NAMING, "weak").count() == 0
