"""The prefix trie against a trie of dictionaries, with small bands too, and against its SQL."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from touchline.llm import op13_prefix_trie as trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        way = tuple(turns[c] if base == c else turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(way) + 1):
            members[way[:d]].add(c)
        ends[way].append(c)
    children = defaultdict(list)
    for way in members:
        if way:
            children[way[:-1]].append(way)
    leaves, saved = {}, {}
    for way in sorted(members, key=len, reverse=True):
        leaves[way] = sum(leaves[x] for x in children[way]) or 1
        saved[way] = sum(saved[x] for x in children[way]) + ((len(members[way]) - 1) * len(way[-1][1]) if way else 0)
    sha = lambda way: hashlib.sha256(",".join(map(str, sorted(ends[way]))).encode()).hexdigest()
    return [(min(members[w]), len(w), min(members[w[:-1]]) if w else None, len(members[w]), len(children[w]), leaves[w], saved[w], sha(w)) for w in members]


def found(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = trie.prefix_trie(df.withColumns({c: F.lit("x") for c in ("d", "p1", "pos", "n", "h", "base", "bytes", "up", "top")}))
    assert got.columns == COLUMNS
    return [tuple(r) for r in got.collect()]


def conversations(seed, n, deep):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-20, 3 * n), n):
        length = r.choice([1, 2, 3, 5, 9, 12, deep])
        rows += [(c, t, r.choice(["user", "assistant"]), r.choice(["", "a", "é", "long text"])) if t > 2 else (c, t, "user", r.choice("ab")) for t in range(length)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_equals_a_trie_of_dictionaries(spark, monkeypatch, small):
    if small:
        for name, value in (("BAND", 2), ("BLOCK", 4), ("CHUNK", 2), ("WIDE", 2)):
            monkeypatch.setattr(trie, name, value)
    rows = conversations(1, 60, 40)
    r = random.Random(2)
    copies = [(c + 1000 * k, t, role, text) for k in range(3) for c, t, role, text in rows if c % 5 == 0 and c >= 0]
    odd = [(None, 1, "user", "lost"), (7777, None, None, None), (7777, None, None, None), (7777, 3, "z", "b"), (7777, 3, "a", "c"), (8000, 0, None, "x" * 5000), (-3, 0, "user", "a"), (2**63 - 1, 1, "user", "a"), (-(2**63), 1, "user", "a")]
    rows = rows + copies + odd
    r.shuffle(rows)
    assert sorted(found(spark, rows), key=str) == sorted(brute(rows), key=str)


def test_a_conversation_over_many_tasks_and_bands(spark):
    rows = [(5, t, "user", "abc"[t % 3]) for t in range(3000)] + [(10, t, "user", "abc"[t % 3]) for t in range(2500)] + [(6, 0, "user", "z")]
    assert sorted(found(spark, rows, 8), key=str) == sorted(brute(rows), key=str)


def test_only_a_root_and_no_rows(spark):
    # 2 has one turn and gives it up for those of 0, which is not there.
    assert zlib.crc32(b"2") % 9 > 0
    assert found(spark, [(2, 0, "user", "a")]) == brute([(2, 0, "user", "a")]) == [(2, 0, None, 1, 0, 1, 0, hashlib.sha256(b"2").hexdigest())]
    assert found(spark, []) == []


def test_sql_on_odd_rows(spark):
    rows = conversations(3, 40, 20) + [(None, 1, "user", "lost"), (7777, None, None, None), (7777, 3, "z", "b"), (-3, 0, "user", "é")]
    con = duckdb.connect()
    frame = spark.createDataFrame(rows, SCHEMA).toPandas()  # noqa: F841  the view's rows
    con.sql("CREATE TABLE conversations AS SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM frame")
    want = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({trie.SQL})").fetchall()
    assert sorted(map(str, want)) == sorted(map(str, brute(rows)))
