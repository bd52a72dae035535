"""Prefix trie against a dictionary of prefixes, and its SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from crashlake.llm import trie as T
from crashlake.llm.oracle import PREFIX_TRIE
from crashlake.llm.queries import op12_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, block string, c1 int, key binary"


def turn_key(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def plain(rows):
    by = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, turn_key(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in by.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    full = {c: own.get(c - c % 20, [])[: h[c]] + own[c][h[c] :] for c in own}
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(who) - 1) * words
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(full[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(who), len(node), parent, len(who), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(seed, n, longest):
    """Shared openings, copies, null roles, texts, turns and ids, ties, repeated rows and turnless conversations."""
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(0, 6 * n), n):
        for t in range(r.choice([1, 1, 2, 3, 5, 9, longest])):
            role = r.choice(["user", "user", None])
            rows.append((c, None if r.random() < 0.03 else t, role, r.choice(["hi there", "hi", "", None, "a b\tc d"]) if t < 4 else f"{t % 3} x", "b", 1, b""))
    rows += [(None, 0, "user", "lost", "b", 1, b""), (40, 0, None, None, "b", 1, b""), (40, 0, None, None, "b", 1, b"")]
    return rows


def ask(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(path / "conversations.parquet"))
    return sorted((tuple(r) for r in op12_prefix_trie(spark, str(path)).collect()), key=repr)


@pytest.mark.parametrize("seed, n, longest", [(1, 3, 4), (2, 60, 20)])
def test_query_matches_dictionary_and_sql(spark, tmp_path, seed, n, longest):
    rows = rows_of(seed, n, longest)
    got = ask(spark, rows, tmp_path)
    assert got == plain(rows)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(con.execute(PREFIX_TRIE).fetchall(), key=repr)


def test_runs_of_runs_and_streamed_ends(spark, tmp_path, monkeypatch):
    """Conversations of more blocks than a run holds, and nodes in which many conversations end."""
    monkeypatch.setattr(T, "RUN", 2)
    monkeypatch.setattr(T, "CHUNK", 3)
    rows = rows_of(5, 25, 70)
    rows += [(1000 + c, t, "user", f"long {t % 7}", "b", 1, b"") for c in range(0, 60, 2) for t in range(40)]
    assert ask(spark, rows, tmp_path) == plain(rows)


def test_turnless_and_empty(spark, tmp_path):
    """A conversation of fewer turns than its shared head that has no base is left without turns."""
    short = [c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:3]
    rows = [(c, 0, "user", "only", "b", 1, b"") for c in short]
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    assert ask(spark, rows, tmp_path / "a") == plain(rows) == [(short[0], 0, None, 3, 0, 1, 0, hashlib.sha256(",".join(map(str, short)).encode()).hexdigest())]
    assert ask(spark, [], tmp_path / "b") == []
