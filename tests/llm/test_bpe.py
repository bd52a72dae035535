"""Byte-level BPE against the tiktoken library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from crashlake.llm import bpe
from crashlake.llm.queries import op11_byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
_R = random.Random(7)
ODD = [
    None, "", " ", "\n\n  x", "don't WE'LL 'tis", "<|endoftext|> ordinary", "É漢字😀 ́" * 30, "a" * 5000, "ab" * 700, " " * 999 + "x", "=" * 3001,
    "".join(_R.choice("abcde") for _ in range(9000)), "".join(_R.choice("=-_*#+/\\|<>") for _ in range(4000)), "".join(chr(_R.randrange(32, 0x2FFF)) for _ in range(3000)),
    "x" * (bpe.WIDE - 1), "y" * bpe.WIDE, "z" * (bpe.WIDE + 1),
]


@pytest.fixture(scope="module")
def ours():
    return bpe.ByteBPE(bpe.read_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_odd_texts(ours, theirs):
    for text, ids in zip(ODD, ours.encode(ODD), strict=True):
        assert ids.tolist() == theirs.encode_ordinary(text or "")
        assert ours.decode(ids) == (text or "").encode()


def test_blocks_of_a_long_text(ours, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "MATCHES", 50)
    text = " ".join(_R.choice(["stone", "Räume", "x1", ",", "12345", "\n"]) for _ in range(3000))
    assert ours.encode(["a", text, "b"])[1].tolist() == theirs.encode_ordinary(text)


def test_forgetting_changes_nothing(ours, theirs):
    ours.parts.forget()
    assert ours.encode(["one two", "two one"])[1].tolist() == theirs.encode_ordinary("two one")


def test_merge_order_of_a_contrived_vocabulary():
    """Lower ranks that arise beside a merge come first, also in a long match."""
    ranks = {bytes([b]): b + 10 for b in range(256)} | {b"ab": 5, b"bc": 6, b"abc": 1, b"cab": 2, b"abab": 0}
    own = bpe.ByteBPE(ranks, r"\S+|\s+")
    slow = tiktoken.Encoding("t", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    for n in (5, 40, 300, 900):
        text = "".join(_R.choice("abc") for _ in range(n))
        assert own.encode([text])[0].tolist() == slow.encode_ordinary(text)


def test_pair_table():
    r = np.random.default_rng(1)
    pairs = np.unique(r.integers(0, 400, (5000, 2)), axis=0)
    table = bpe.PairTable(pairs[:, 0], pairs[:, 1], np.arange(len(pairs)))
    known = {tuple(p): i for i, p in enumerate(pairs.tolist())}
    a, b = r.integers(0, 400, 20000), r.integers(0, 400, 20000)
    assert table.find(a, b).tolist() == [known.get(x, int(bpe.NONE)) for x in zip(a.tolist(), b.tolist(), strict=True)]


def test_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(i, t, b"old", "x") for i, t in enumerate(ODD)], "doc_id long, text string, ids binary, decoded string")
    rows = bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect()
    assert sorted(rows[0].asDict()) == ["decoded", "doc_id", "ids", "text"]
    back = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN, ["doc_id"]), PATH, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in back.collect()} == {i: (t or "").encode() for i, t in enumerate(ODD)}
    assert bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN, decoded=True).count() == 0


def test_query(spark, theirs, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (1 << 60, "big"), (1 << 60, "big")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in op11_byte_bpe(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = theirs.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
