import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import hamming

SCHEMA = "id long, n int, first array<long>, last array<long>"
signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x


def brute(rows, most, more=2):
    links, members = set(), set()
    for k, side in ((2, "first"), (3, "last")):
        own = sorted({(r[0], r[1], tuple(r[k])) for r in rows if r[0] is not None and r[1] is not None and r[k]})
        rep = {}
        for i, n, p in own:
            rep.setdefault((n, p), i)
            members.add((i, side, rep[n, p]))
        for (na, pa), a in rep.items():
            for (nb, pb), b in rep.items():
                if len(pa) == len(pb) and (0 < nb - na <= more or na == nb and a < b):
                    d = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(pa, pb, strict=True))
                    if d <= most:
                        links.add((side, a, b, d))
    return links, members


def made(n, words, seed):
    """Prints around a few centres, with blank margins, exact copies and prints that differ in about the limit."""
    random.seed(seed)
    blank = [0] * (words // 3)
    centres = [blank + [random.getrandbits(64) for _ in range(words - len(blank))] for _ in range(4)]

    def near(c):
        out = list(c)
        for _ in range(random.choice([0, 1, 3, 40, 60, 90])):
            out[random.randrange(words)] ^= 1 << random.randrange(64)
        return [signed(x) for x in out]

    rows = [(i, random.randrange(1, 7), near(random.choice(centres)), near(random.choice(centres))) for i in range(n)]
    return rows + rows[:5] + [(n + i, *rows[i][1:]) for i in range(20)]


@pytest.mark.parametrize("words,most", [(32, 100), (32, 20), (128, 100), (1, 5)])
def test_links_equal_brute_force(spark, words, most):
    rows = made(150, words, words + most) + [(9000, 3, None, [1] * words), (9001, None, [1] * words, [1] * words), (None, 1, [0] * words, [0] * words), (9002, 2, [1], [7, 7]), (9003, 2, [1], [7, 6]), (9004, 2, [], [])]
    links, members = hamming.near_prints(spark.createDataFrame(rows, SCHEMA).repartition(3), most)
    want = brute(rows, most)
    assert ({tuple(r) for r in links.collect()}, {tuple(r) for r in members.collect()}) == want and len(want[0]) > 20
    assert links.count() == len(want[0])


def test_flipped_bands_find_the_same(spark, monkeypatch):
    rows = made(60, 32, 9)
    monkeypatch.setattr(hamming, "index_of", lambda most, bits, n: (most // 2 + 1, 1))
    links, _ = hamming.near_prints(spark.createDataFrame(rows, SCHEMA), 100)
    assert {tuple(r) for r in links.collect()} == brute(rows, 100)[0]


def test_index_sizes():
    assert hamming.index_of(100, 2048, 1000) == (204, 0) and hamming.index_of(100, 2048, 10**6) == (102, 0) and hamming.index_of(100, 2048, 10**8) == (51, 1) and hamming.index_of(100, 8192, 10**9) == (273, 0)


def test_common_values_are_no_keys(spark):
    """A third of all bits is blank in every print: links are few, and so are the pairs that are compared."""
    random.seed(1)
    rows = [(i, 1, [0] * 11 + [signed(random.getrandbits(64)) for _ in range(21)], [signed(random.getrandbits(64)) for _ in range(32)]) for i in range(400)]
    seen = []
    real = hamming.skew.lookup
    hamming.skew.lookup = lambda left, right, on: (seen.append(left.count()), real(left, right, on))[1]
    try:
        links, _ = hamming.near_prints(spark.createDataFrame(rows, SCHEMA), 100)
        assert links.count() == 0 and seen[1] < 400 * 399 // 2 * 2
    finally:
        hamming.skew.lookup = real


def test_page_prints_equal_brute_force(spark):
    random.seed(2)
    pages = [(1, 20, 31, [random.randrange(256) for _ in range(620)]), (2, 5, 7, [random.randrange(256) for _ in range(35)]), (3, 9, 9, [5] * 81), (4, 0, 0, []), (5, 3, 3, [1]), (6, None, None, None)]
    got = {r.k: r.print for r in hamming.page_prints(spark.createDataFrame(pages, "k int, w int, h int, px array<int>"), "k", 8).collect()}
    for k, w, h, px in pages[:3]:
        cut = lambda i, m: range(i * m // 9, max(i * m // 9 + 1, (i + 1) * m // 9))
        g = [[sum(px[y * w + x] for y in cut(j, h) for x in cut(i, w)) / (len(cut(j, h)) * len(cut(i, w))) for i in range(9)] for j in range(9)]
        bits = [g[y][x] > g[y][x + 1] for y in range(8) for x in range(8)] + [g[y][x] > g[y + 1][x] for y in range(8) for x in range(8)]
        assert got[k] == [signed(int("".join("01"[b] for b in bits[i : i + 64]), 2)) for i in (0, 64)]
    assert got[4] is None and got[5] is None and got[6] is None


def test_distance(spark):
    r = spark.range(1).select(hamming.distance(F.array(F.lit(-1).cast("long"), F.lit(3).cast("long")), F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("d"), hamming.distance(F.array(F.lit(1)), F.array(F.lit(1), F.lit(1))).alias("n")).first()
    assert (r.d, r.n) == (65, None)  # 64 bits of -1, one of 3


@pytest.mark.parametrize("block", [7, 4096])
def test_prints_of_few_values_are_compared_in_blocks(spark, monkeypatch, block):
    """Bands of a number's level have few values, so keys would bring most pairs together many times."""
    random.seed(3)
    level = lambda: signed((1 << random.randrange(25, 40)) - 1)
    rows = [(i, random.randrange(4), [level() for _ in range(32)], [level() for _ in range(31)]) for i in range(120)]
    monkeypatch.setattr(hamming, "BLOCK", block)
    seen, real = [], hamming.compared
    monkeypatch.setattr(hamming, "compared", lambda *a: seen.append(1) or real(*a))
    links, members = hamming.near_prints(spark.createDataFrame(rows, SCHEMA), 130)
    want = brute(rows, 130)
    got = [tuple(r) for r in links.collect()]
    assert seen and len(got) == len(set(got)) > 20 and (set(got), {tuple(r) for r in members.collect()}) == want
