import duckdb

from folioscope.llm import linededup, queries


def brute(rows):
    first, out = {}, {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for d, t in order:
        if t is None:
            continue
        lines, gone = t.split("\n"), set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if first.setdefault(w, (d, i)) != (d, i):
                gone |= {i, i + 1, i + 2}
        out[d, t] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return [(d, *out.get((d, t), (None, 0, 0))) for d, t in rows]


def test_windows_equal_brute_force_and_edge_cases(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb\nc\nd\na\nb\nc\nd"), (4, None), (5, ""), (6, "a\nb"), (7, "\n\n\n\n\n"), (8, "z\n\n\n\nq"), (9, "q\nq\nq\nq\nq"), (None, "a\nb\nc"), (1, "a\nb\nc\nd"), (10, "l\n" * 3000)]
    docs = spark.createDataFrame([(d, t, 9, "k") for d, t in rows], "doc_id long, text string, n_lines int, k1 string")
    got = linededup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "k1", "n_lines", "n_removed"]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=key) == sorted(brute(rows), key=key)
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_sql_agrees(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{sf}/documents.parquet'")
    want = sorted(duckdb.sql(linededup.SQL).fetchall())
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.kept_md5) for r in queries.op6_line_dedup(spark, sf).collect())
    assert got == want and any(r[2] for r in want)
