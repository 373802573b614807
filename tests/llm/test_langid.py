import numpy as np

from folioscope.llm import langid


def greedy(text: bytes, sample: bytes) -> int:
    total = 0
    for b in range(0, len(text), langid.BLOCK):
        block, n, i = text[b : b + langid.BLOCK], 0, 0
        while i < len(block):
            j = i
            while j < len(block) and block[i : j + 1] in sample:
                j += 1
            if j == i:  # a byte that the language lacks
                n, i = n + 1, i + 1
            else:
                n, i = n + (j < len(block)), j
        total += n + 1
    return total


def test_phrases_equal_a_plain_greedy_parse():
    rng = np.random.default_rng(1)
    samples = tuple((c, bytes(rng.choice(list(alphabet), 400))) for c, alphabet in (("p", b"abc "), ("q", b"bcd ")))
    texts = [bytes(rng.choice(list(b"abcdz "), n)) for n in (0, 1, 5, 511, 512, 513, 1500)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.cumsum([0, *map(len, texts)])
    got = langid.parser(samples).phrases(data, at)
    assert got.tolist() == [[greedy(t, s) for _, s in samples] for t in texts]


def test_held_out_accuracy_and_edge_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    samples = langid.fit(docs.where("doc_id % 4 <> 2"))
    assert [s[0] for s in samples] == ["de", "en", "es", "fr"]
    got = langid.identify(docs.where("doc_id % 4 = 2"), samples)
    assert got.where("lang_pred = lang").count() >= 0.97 * got.count()
    odd = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (3, "12 ###", 5.0), (None, "thing", 5.0), (4, "thing", 5.0), (4, "thing", 5.0)], "doc_id long, text string, score double")
    rows = langid.identify(odd, samples).collect()
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and [r.score for r in rows[:3]] == [0.0] * 3
    assert rows[4] == rows[5] and rows[3].lang_pred == rows[4].lang_pred
    assert langid.fit(docs.limit(0)) == ()
    assert {r.lang_pred for r in langid.identify(odd, ()).collect()} == {"und"}
    assert langid.identify(odd.limit(0), samples).count() == 0
