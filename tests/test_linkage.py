import random

from folioscope.functions import similarity
from folioscope.operators import dedup, linkage, rank

F = similarity.F


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def alike(a, b):
    d = edits(a, b)
    return d <= max(1, max(len(a), len(b)) // 4) or (a[:3] == b[:3] and min(len(a), len(b)) >= 5 and d <= 2)


def test_similar_names_finds_every_pair(spark):
    rng = random.Random(2)

    def changed(s, n):
        for _ in range(n):
            i = rng.randrange(len(s) + 1)
            s = rng.choice([s[:i] + rng.choice("abc") + s[i:], s[: max(0, i - 1)] + s[i:], s[:i] + rng.choice("abc") + s[i + 1 :]])
        return s

    base = ["".join(rng.choice("abc") for _ in range(n)) for n in [0, 1, 3, 5, 8, 10, 11, 12, 13, 16, 20, 27] for _ in range(3)]
    others = [changed(s, rng.randrange(len(s) // 3 + 2)) for s in base for _ in range(6)]
    a, b = (spark.createDataFrame([(s,) for s in [*x, None, x[-1]]], f"{n} string") for x, n in ((base, "a"), (others, "b")))
    got = {tuple(r) for r in linkage.similar_names(a, b).collect()}
    want = {(x, y) for x in base for y in others if alike(x, y)}
    assert got == want and sum(max(map(len, p)) > 11 for p in want) > 30


def test_title_duplicates_equal_pairs(spark):
    long = "A treatise on the harmony of the spheres and all"
    titles = [long, long + " their music", long + " II", long + " 3", long + " 3", long.upper() + "!", "Short one", "short  one", "Short one more", "tiny", None, long + " their music and more", "Another " + long]
    docs = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    x, y = docs.toDF("id", "ta"), docs.toDF("match", "tb")
    ct = lambda c: F.length(dedup.text.compact_title(F.col(c))) >= 8
    pairs = x.join(y, F.col("id") != F.col("match")).where(ct("ta") & ct("tb") & similarity.title_equal(F.col("ta"), F.col("tb")))
    want = {r.id: r.m for r in pairs.groupBy("id").agg(F.min("match").alias("m")).collect()}
    got = {r.id: r.match for r in dedup.title_duplicates(docs).collect()}
    assert got == want and got[1] == 0 and got[0] == 1 and 12 not in got


def test_names_of_nine_digits_meet_few_others(spark):
    """They are no names of over 11 characters, whose pieces stand in nearly every other, and each pair that may be alike comes once."""
    a, b = ([f"{i * step:09d}" for i in range(n)] for n, step in ((600, 37), (300, 91)))
    names = [spark.createDataFrame([(s,) for s in x], f"{c} string") for x, c in ((a, "a"), (b, "b"))]
    want = sorted((x, y) for x in a for y in b if alike(x, y))
    assert sorted(tuple(r) for r in linkage.similar_names(*names).collect()) == want and len(want) > 300
    assert linkage._long_names(*names).count() == 0 and sorted(tuple(r) for r in linkage._short_names(*names).collect()) == want


def _worded(spark):
    random.seed(7)
    of = lambda most: random.sample([f"w{i}" for i in range(40)], random.randrange(most))
    a = [(i, of(30), random.choice(["x", None])) for i in range(700)] + [(700, None, "x"), (701, [], "x")]
    b = [(i, of(9)) for i in range(12)] + [(12, []), (13, ["w1", "w2", "w3"])]
    return a, b, spark.createDataFrame(a, "id long, words array<string>, lang string"), spark.createDataFrame(b, "match long, words array<string>")


def test_shared_words_by_counting_and_by_join(spark, monkeypatch):
    a, b, da, db = _worded(spark)
    want = {(i, x, m, len(w), len(v), len({*w} & {*v})) for i, w, x in a if w for m, v in b if {*w} & {*v}}
    out = linkage.shared_words(da, db)
    got = [tuple(r) for r in out.select("id", "lang", "match", "na", "nb", "shared").collect()]
    assert len(got) == len(want) and set(got) == want
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()  # a row for each pair is not shuffled
    monkeypatch.setattr(linkage, "SENT", -1)
    assert {tuple(r) for r in linkage.shared_words(da, db).select("id", "lang", "match", "na", "nb", "shared").collect()} == want


def test_links_by_counting_and_by_join(spark, monkeypatch):
    a, b, da, db = _worded(spark)
    want = {(i, m) for i, w, _ in a if w for m, v in b if len(v) >= 3 and len({*w} & {*v}) >= 0.6 * len(v)}
    for sent in (linkage.SENT, -1):
        monkeypatch.setattr(linkage, "SENT", sent)
        out = linkage.word_links(da, db, 0.6).where(similarity.containment_from(F.col("shared"), F.col("nb"), F.col("na")) >= 0.6)
        assert {(r.id, r.match) for r in out.collect()} == want and want


def test_pairs_left_out_change_no_choice(spark):
    _, _, da, db = _worded(spark)
    scored = lambda keep: linkage.shared_words(da, db, keep).select("id", "match", F.col("na").alias("work"), "lang", F.col("id").cast("string").alias("name"), rank.confidence_of(F.col("shared"), F.col("nb"), F.col("na")).alias("confidence"))
    same = lambda f, keep: sorted(map(tuple, f(scored(keep)).collect())) == sorted(map(tuple, f(scored(None)).collect()))
    assert same(lambda c: rank.choose(c, "match", "work"), rank.best(2)) and same(lambda c: rank.top(c, "match", 10, "confidence desc, id").select("match", "id", "rank"), rank.best(10))
    assert same(lambda c: rank.fill_winner(c.withColumn("lang", F.coalesce("lang", F.lit(""))), "match", "work", ["lang", "name"]), rank.near_best)
    assert scored(rank.best(2)).count() < scored(None).count()
