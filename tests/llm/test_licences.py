import re

import duckdb

from folioscope.llm import licences, queries


def brute(text, dice):
    if text is None:
        return set(), None, 0
    pairs = lambda w: list(zip(w, w[1:], strict=False))
    hits, windows, all_ = [], 0, pairs(licences.plain_words(text))
    for name, t in licences.TEMPLATES:
        seq = pairs(licences.plain_words(t))
        b = set(seq)
        for p in {text, *re.split(r"\n[ \t\r]*\n", text), *text.split("\n")}:
            a = set(pairs(licences.plain_words(p)))
            if a and b and 2 * len(a & b) / (len(a) + len(b)) >= dice:
                hits.append((-2 * len(a & b) / (len(a) + len(b)), name))
        best = 0
        for i, g in enumerate(all_):
            if g in b and (not i or all_[i - 1] not in b):
                a = set(all_[i : i + len(seq)])
                best = max(best, 2 * len(a & b) / (len(a) + len(b)))
        if best >= dice:
            hits.append((-best, name))
            windows += 1
    return {n for _, n in hits}, min(hits)[1] if hits else None, windows


def test_scan_equals_brute_force_and_edge_cases(spark):
    mit = licences.NOTICES[2][1]
    whole = dict(licences.TEXTS)
    comment = lambda t: "\n".join("# " + x for x in t.split("\n"))
    texts = [None, "", "a", "two words", "Released under the MIT License.", "intro\nreleased   UNDER the mit license\nmore", mit.replace(" ", "\n"), "text\n\n" + mit.replace("software", "programme") + "\n\nmore", "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", "Licensed under CC BY 4.0.", "word " * 5000, mit + "\n" + mit]
    texts += ["This module is small and useful. Released under the MIT License. See the docs for more.", "import x\n" + comment(whole["MIT"]) + "\ndef f(): pass\n" * 90, "x = 1  // SPDX-License-Identifier: EPL-2.0 and more of the same", whole["GPL-3.0"][:420], "prose " * 300 + whole["Apache-2.0"] + " prose" * 20_000, whole["GPL-2.0"].replace("\n", " ")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[4], "x"), (4, texts[4], "x")], "doc_id long, text string, licences string")
    got = licences.scan(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got[: len(texts)]:
        assert (set(r.licences), r.best_licence, r.n_windows) == brute(r.text, licences.DICE), (r.text or "")[:90]
    assert got[4].best_dice == 1.0 and got[-1] == got[4] and got[0].n_passages == 0
    assert ["MIT" in got[i].licences for i in (12, 13)] == [True, True] and got[14].licences == ["EPL-2.0"]
    assert "GPL-3.0" in got[15].licences and "Apache-2.0" in got[16].licences and "GPL-2.0" in got[17].licences
    assert licences.scan(docs.limit(0)).count() == 0
    assert licences.scan(docs, []).where("size(licences) > 0").count() == 0


def test_sql_agrees(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{sf}/documents.parquet'")
    key = lambda r: r[0]
    want = sorted(duckdb.sql(licences.sql()).fetchall(), key=key)
    got = sorted(((r.doc_id, r.licences, r.best_licence, r.best_dice, r.n_passages, r.n_windows) for r in queries.op10_license_scan(spark, sf).collect()), key=key)
    assert got == want and any(r[4] for r in want) and any(r[5] for r in want)


def test_every_whole_licence_meets_itself(spark):
    docs = spark.createDataFrame([(n, t) for n, t in licences.TEXTS], "name string, text string")
    assert all(r.name in r.licences and r.best_dice == 1.0 for r in licences.scan(docs).collect())
