import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np

from folioscope.llm import lm, queries

F = queries.F


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate({i: i + 32 for i in range(65, 91)})), None]


class Model:
    """The model in plain Python: true levels, no hashing."""

    def __init__(self, texts):
        toks = [tokens(t) for t in texts]
        self.c = Counter(w for ws in toks for w in ws)
        self.pairs = Counter(p for ws in toks for p in zip([0, *ws], ws))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.after = defaultdict(list)
        for (u, _), n in self.pairs.items():
            self.after[u].append(self.count(n))

    @staticmethod
    def count(n):
        level = math.floor(math.log2(n)) if n else 0
        return round(1.4 * 2**level) if level else min(n, 1)

    def base(self, w):
        return (self.c[w] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def p(self, u, w):
        if u not in self.after:
            return self.base(w)
        q = self.count(self.pairs[u, w])
        return (max(q - lm.DISCOUNT, 0) + lm.DISCOUNT * len(self.after[u]) * self.base(w)) / sum(self.after[u])

    def row(self, text):
        ws = tokens(text)
        return len(ws), sum(self.c[w] > 0 for w in ws), self.n, sum(math.log10(self.base(w)) for w in ws), sum(math.log10(self.p(u, w)) for u, w in zip([0, *ws], ws))


def same(got, want):
    return got[:3] == want[:3] and all(math.isclose(g, w, rel_tol=1e-9) for g, w in zip(got[3:], want[3:], strict=True))


def test_scores_equal_the_plain_model_on_odd_rows(spark):
    rows = [(1, "A b c a"), (2, None), (3, ""), (4, "b\tc\n\nD"), (5, "a " * 3000), (6, "b c"), (6, "b c"), (7, "zzz a"), (None, "c b"), (14, " ".join(f"x{i}" for i in range(40_000)))]
    clash = "words double, types int, logs string, is_stat boolean, own int, block int, held string, segment int, n int, levels int, score double, n_known int"
    docs = spark.createDataFrame([(d, t, 1.0, 2, "l", True, 3, 4, "h", 5, 6, 7, 9.5, 8) for d, t in rows], "doc_id long, text string, " + clash)
    got = lm.score(docs, F.col("doc_id") % 7 == 0).collect()
    model = Model([t for d, t in rows if d is None or d % 7])
    key = lambda r: (r[0] is None, r[0] or 0)
    assert len(got) == len(rows)
    for g, (d, t) in zip(sorted(got, key=key), sorted(rows, key=key), strict=True):
        assert (g.doc_id, g.held_out) == (d, d is not None and d % 7 == 0)
        assert same((g.n_tokens, g.n_known, g.train_tokens, g.base_score, g.score), model.row(t))
        assert (g.words, g.types, g.logs, g.is_stat, g.own, g.block, g.held, g.segment, g.n, g.levels) == (1.0, 2, "l", True, 3, 4, "h", 5, 6, 7)
    assert lm.score(docs.limit(0), F.lit(False)).count() == 0
    alone = lm.score(docs, F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens) for r in alone} == {(0, 0)} and all(r.score == r.base_score for r in alone)


def test_probabilities_sum_to_one_and_counts_of_one_are_kept(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.3, 60) % 400) for _ in range(60)]
    model = Model([t for i, t in enumerate(texts) if i % 3])
    for u in [*model.after, "unknown"]:
        assert math.isclose(sum(model.p(u, w) for w in [*model.c, "unknown"]), 1, rel_tol=1e-9)
    assert sum(n == 1 for n in model.pairs.values()) > 0.5 * len(model.pairs)
    # every word after every other of a few, so that what the engine gives after a word can be added up
    some = [*sorted(w for w in model.c if w)[:12], "unknown"]
    texts += [""] * (60 - len(texts)) + [f"{u} {w}" for u in some for w in some]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    block, segment = lm.BLOCK, lm.SEGMENT
    lm.BLOCK, lm.SEGMENT = 4096, 256
    try:
        got = {r.doc_id: r for r in lm.score(docs, (F.col("doc_id") % 3 == 0) | (F.col("doc_id") >= 60)).collect()}
    finally:
        lm.BLOCK, lm.SEGMENT = block, segment
    for i, t in enumerate(texts):
        assert same((got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].base_score, got[i].score), model.row(t)), t


def test_filter_reads_every_level_and_hardly_a_false_one():
    rng = np.random.default_rng(5)
    h = np.unique(rng.integers(0, 1 << 40, 300_000, dtype=np.uint64))
    n = rng.zipf(1.6, len(h)).clip(max=1 << 40) * (rng.random(len(h)) < 0.5)
    flags = lm.segment_of(h, n)
    want = np.where(n > 0, 1 + np.floor(np.log2(np.maximum(n, 1))), 0).astype(int)
    got = lm.levels_of(flags, h)
    assert (got >= want).all() and (got > want).mean() < 5e-5
    assert len(flags) >= lm.BITS * want.sum() - 8
    assert lm.levels_of(lm.segment_of(h[:0], n[:0]), h[:9]).max() == 0


def test_sql_agrees_and_held_out_texts_score_better_than_by_words_alone(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op4_lm_scoring(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 10 == 0) for d, r in got.items())
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{sf}/documents.parquet'")
    rows = duckdb.sql("SELECT doc_id, text FROM documents").fetchall()
    model = Model([t for d, t in rows if zlib.crc32(str(d).encode()) % 10])
    close = 0
    for d, t in rows:
        g, w = got[d], model.row(t)
        assert same((g.n_tokens, g.n_known, g.train_tokens, g.base_score), w[:4])
        close += math.isclose(g.score, w[4], rel_tol=1e-9)
        assert math.isclose(g.score, w[4], rel_tol=0.005)
    assert close >= 0.8 * len(rows)  # one false reading shows in all texts with that word before
    held = [r for r in got.values() if r.held_out]
    print("held out: base", sum(r.base_score for r in held), "model", sum(r.score for r in held))
    assert sum(r.score for r in held) >= sum(r.base_score for r in held)
