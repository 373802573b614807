from tests.llm.test_decontaminate import brute as tiles
from tests.llm.test_linededup import brute as line_brute
from tests.llm.test_minhash import brute as near_brute

import corpus_pipeline


def words(t):
    import re

    return re.findall("[0-9a-z\x80-\U0010ffff]+", t.translate({i: i + 32 for i in range(65, 91)}))


def test_pipeline_equals_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(d, t) for d, t in rows if t and any(c.isalpha() for c in t)]
    rows = [(d, t) for d, t, n, gone in line_brute(rows) if gone < n or not gone]
    comp = near_brute(rows, 5, 80)
    rows = [r for r, (d, _, c) in zip(rows, comp, strict=True) if d == c]
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def clean(t):
        w = words(t)
        for i in items:
            k = min(5, len(i))
            if any(i[j : j + k] == w[x : x + k] for j in range(len(i) - k + 1) for x in range(len(w) - k + 1)) and sum(tiles(i, w, k)) >= 0.8 * len(i):
                return False
        return True

    want = {d: t for d, t in rows if clean(t)}
    got = corpus_pipeline.run(spark, sf)
    assert got.columns[:5] == docs.columns
    out = got.collect()
    assert {r.doc_id: r.text for r in out} == want and len(out) == len(want) < docs.count()
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in out)


def test_stages_take_odd_rows(spark, sf):
    docs = spark.createDataFrame([(None, "a null id", "en", "s", 9), (1, None, "en", "s", 0), (2, "", None, None, None), (3, "a text", None, None, None), (3, "a text", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for frame, n in ((docs, 2), (docs.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, sf)
        assert frame.count() == n


def test_stages_keep_columns_that_are_called_like_their_own(spark, sf):
    names = ["lang_pred", "score", "n_lines", "n_removed", "n_items", "best_item", "best_coverage", "contaminated", "token_ids", "n_tokens", "round_trip", "kept", "component_id", "n_shingles", "k1", "k2", "at", "node", "bucket", "t1", "t2", "seed", "item", "own"]
    texts = ["one two three", "one two three", "x\ny\nz\nw", "new\nx\ny\nz", "long " * 30_000, None, ""]
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r[:2], "en", *r[2:]) for r in rows], "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names))
    frame = docs
    for _, stage in corpus_pipeline.STAGES:
        frame = corpus_pipeline.stored(stage(spark, frame, sf), "stage")
    assert frame.columns == [*docs.columns, "token_ids_", "n_tokens_", "round_trip_"]
    got = sorted(frame.collect())
    assert [r.doc_id for r in got] == [0, 2, 3, 4] and got[2].text == "new"
    for r in got:
        assert all(r[n] == f"{n}{r.doc_id}" for n in names) and r["round_trip_"]


def test_documents_stay_where_no_language_was_learnt(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for lang_of_no_text in (None, "en"):
        docs = spark.createDataFrame([(1, "a text", None, "s", 6), (2, "another one", None, "s", 11), (3, "12 !", None, "s", 4), (4, None, lang_of_no_text, "s", 0)], schema)
        assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, sf).collect()) == [1, 2]
