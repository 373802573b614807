import hashlib
import random
import zlib
from collections import defaultdict

import duckdb

from folioscope.llm import queries, trie
from tests.compare import compared

SCHEMA = "conv_id long, turn long, role string, text string, depth int, node string"


def brute(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for *_, r, _, t in sorted(v)] for c, v in own.items()}
    full = dict(own)
    if rebuild:
        for c, v in own.items():
            h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c > 0 else -1)
            full[c] = own.get(base, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out = []
    for path, m in members.items():
        sub = [p for p in members if p[: len(path)] == path]
        children = lambda p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)
        ends = ",".join(map(str, sorted(c for c in m if len(full[c]) == len(path))))
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in sub if p)
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), children(path), sum(not children(p) for p in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=repr)


def made(n=60):
    random.seed(5)
    rows = []
    for c in [*range(n), -3, -7, 10_000, 4_097, 10**12]:
        size = random.choice([0, 1, 2, 3, 9, 12]) if c % 7 else 4
        rows += [(c, random.choice([None, 1, 2, 3, 4]), random.choice(["user", "assistant", None]), random.choice(["é", "", None, "a", "bb", "a,b"]) if c % 7 else "same", 9, "x") for _ in range(size)]
    return rows + rows[:9] + [(None, 1, "user", "lost", 9, "x"), (1, 2, "user", "z" * 100_000, 9, "x")]


def test_trie_equals_brute_force(spark):
    rows = made()
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = trie.prefix_trie(*trie.rebuilt(trie.turns(table)))
    assert got.columns[:8] == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert found(got) == brute(rows)
    assert found(trie.prefix_trie(trie.turns(table))) == brute(rows, rebuild=False)


def test_empty_and_turnless(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(*trie.rebuilt(trie.turns(none))).count() == 0
    one = spark.createDataFrame([(7, 0, "user", "x", 1, "")], SCHEMA)  # the head of 7 is 1 or more, and conversation 5 is absent
    assert found(trie.prefix_trie(*trie.rebuilt(trie.turns(one)))) == brute([(7, 0, "user", "x")])


def test_a_node_with_many_blocks_of_ids(spark):
    ids = [i * 977 for i in range(-200, 9000)]
    rows = [(i, 1, "user", "hi" if i % 3 else "ho", 0, "") for i in ids]
    got = found(trie.prefix_trie(trie.turns(spark.createDataFrame(rows, SCHEMA))))
    digest = lambda rest: hashlib.sha256(",".join(str(i) for i in sorted(ids) if bool(i % 3) == rest).encode()).hexdigest()
    assert [r[7] for r in got if r[1] == 1 and r[3] > 4000] == [digest(True)] and digest(False) in {r[7] for r in got}


def test_one_long_conversation(spark):
    rows = [(0, i, "user", str(i % 3), 0, "") for i in range(4000)] + [(5, i, "user", str(i % 3), 0, "") for i in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that it lies in several ranges
    got = {r[1]: r for r in found(trie.prefix_trie(trie.turns(spark.createDataFrame(rows, SCHEMA).repartition(8))))}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 4001 and got[0][3:7] == (2, 1, 1, 300) and got[300][3:7] == (2, 1, 1, 1) and got[301][3:7] == (1, 1, 1, 0)


def test_sql_agrees(spark, sf):
    compared(spark, sf, "op12", queries.op12_conversation_prefix_trie, trie.SQL)
    con = duckdb.connect()
    rows = made(40)
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    assert sorted(con.sql(trie.SQL).fetchall(), key=repr) == brute(rows)
