"""Merkle manifest against a plain recursive tree, and its SQL."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from crashlake.llm import manifest as M
from crashlake.llm.oracle import MANIFEST
from crashlake.llm.queries import op13_manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, level int, tree string, seg binary"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def tree(leaves):
    """The root, and for each leaf its siblings with their side."""
    if len(leaves) == 1:
        return leaves[0], [[]]
    above, rest = tree([sha("".join(leaves[i : i + 2])) for i in range(0, len(leaves), 2)])
    own = [[("L", leaves[i - 1])] if i % 2 else [("R", leaves[i + 1])] if i + 1 < len(leaves) else [("", "")] for i in range(len(leaves))]
    return above, [own[i] + rest[i // 2] for i in range(len(leaves))]


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    groups = []
    for lang in sorted(by, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(by[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        groups.append((own, *tree([leaf(r) for r in own])))
    root, top = tree([sub for _, sub, _ in groups])
    out = []
    for (own, sub, proofs), up in zip(groups, top, strict=True):
        for r, proof in zip(own, proofs, strict=True):
            i, n = r["doc_id"], r["n_chars"]
            altered = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
            h = leaf({**r, "n_chars": n + 1} if altered else r)
            for side, other in proof + up:
                h = sha(other + h if side == "L" else h + other)
            out.append((i, leaf(r), sub, root, sha("".join(x for _, x in proof + up)), h, h == root))
    return out


def rows_of(n):
    """One language with most rows, null and lone ones, repeated rows, null fields and ids beyond 2^53."""
    rows = [(i, f"text {i}" * (i % 5), ["en", "en", "en", "de", None][i % 5], "s", i, 1, "t", b"x") for i in range(n)]
    rows += [(7, "same id", "en", None, None, 1, "t", b""), (None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    rows += [(1 << 60, "big", "fr", "é漢", (1 << 63) - 1, 0, "", b""), ((1 << 60) + 1, "long " * 200_000, "en", "s", 1, 0, "", b""), (3, "text 3", "de", "s", 3, 0, "", b""), (3, "text 3", "de", "s", 3, 0, "", b"")]
    return rows


def asked(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(path / "documents.parquet"))
    return sorted((tuple(r) for r in op13_manifest(spark, str(path)).collect()), key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 700])
def test_query_matches_plain_tree_and_sql(spark, tmp_path, n):
    rows = rows_of(n)
    got = asked(spark, rows, tmp_path)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    assert got == sorted(plain([dict(zip(names, r, strict=True)) for r in rows]), key=repr)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(MANIFEST).fetchall(), key=repr)


def test_single_row_and_empty_table(spark, tmp_path):
    one = [(5, "x", "en", "s", 1, 0, "", b"")]
    (tmp_path / "one").mkdir(), (tmp_path / "none").mkdir()
    got = asked(spark, one, tmp_path / "one")
    digest = leaf(dict(zip(FIELDS, (5, "s", "en", 1, "x"), strict=True)))
    assert got == [(5, digest, digest, digest, sha(""), digest, True)]
    assert asked(spark, [], tmp_path / "none") == []


def test_several_spans_and_many_groups(spark, monkeypatch):
    """Trees higher than one span, and rounds whose targets aren't broadcast."""
    monkeypatch.setattr(M, "SPAN", 2)
    monkeypatch.setattr(M, "FEW", 3)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 40 * (F.col("id") % 3 > 0).cast("int")).cast("string").alias("lang"))
    docs = docs.select("doc_id", "lang", F.lit("s").alias("source"), F.col("doc_id").alias("n_chars"), F.col("lang").alias("text"))
    got = M.manifest(docs).select("doc_id", M.text_of(F.col("root")).alias("r"), (M.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok"), F.sha2(M.siblings(F.col("proof")), 256).alias("p")).collect()
    want = {x[0]: (x[3], x[4]) for x in plain([r.asDict() for r in docs.collect()])}
    assert len(got) == 300 and all(r.ok for r in got)
    assert {r.doc_id: (r.r, r.p) for r in got} == want
