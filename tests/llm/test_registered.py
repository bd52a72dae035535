"""Registered queries and pipeline stages over a small folder with clashing columns, nulls, repeated ids and a long text."""

import random
import re
import zlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from crashlake.llm import decontaminate
from crashlake.llm.common import table
from crashlake.llm.queries import END_ID, QUERIES, tokenizer_path

CLASHING = ["copies", "_row", "_size", "_items", "_coverage", "_toxicity", "_evidence", "score", "_copy", "_place", "extra_0"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
WORDS = "stone river house garden winter letter answer paper window quiet long table field summer music story".split()
BIG = (1 << 60) + 1


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ed", "ly"]) for _ in range(n))


ITEM = prose(900, 40)


def texts():
    out = [(i, prose(i, 60 + i % 50)) for i in range(120)]
    out += [(200 + i, prose(200 + i, 40) + " grobian lump") for i in range(40)]  # labelled toxic
    out += [(300, prose(3, 63)), (301, prose(3, 63) + " more"), (302, prose(5, 65))]  # copies of 3 and 5
    out += [(310, prose(310, 30) + " " + ITEM + " " + prose(311, 30)), (311, ITEM)]
    out += [(320, None), (321, ""), (322, " \n "), (None, prose(330, 50)), (None, prose(331, 50)), (BIG, prose(332, 50)), (BIG - 2, prose(333, 20))]
    out += [(340, prose(340, 30)), (340, prose(341, 200)), (341, prose(342, 400_000))]  # one id twice; some MB
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en" if k % 5 else None, ["a", "b", None][k % 3], len(t or ""), *[f"{c}{k}" for c in CLASHING]) for k, (i, t) in enumerate(texts())]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    labels = [(i, 1, int(200 <= i < 300)) for i, _ in texts() if i is not None and i < 300] + [(None, 1, 1), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None), (None, prose(901, 30)), (3, "")], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    turns = [(c, t, "user", f"turn {t}") for c in range(30) for t in range(c % 4 + 1)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(path / "conversations.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def none(spark, folder, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "benchmark", "conversations"):
        table(spark, folder, name).limit(0).write.parquet(str(path / f"{name}.parquet"))
    return str(path)


def rows_of(df):
    return Counter(map(tuple, df.collect()))


PER_DOCUMENT = [n for n in QUERIES if not n.startswith(("op9_", "op12_"))]


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_per_document(spark, folder, name):
    got = Counter(r.doc_id for r in QUERIES[name](spark, folder).select("doc_id").collect())
    assert got == Counter(i for i, _ in texts())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, none, name):
    assert QUERIES[name](spark, none).collect() == []


def test_decontamination_is_that_of_each_text(spark, folder):
    own = [decontaminate.tokens(ITEM), decontaminate.tokens(prose(901, 30))]
    block = decontaminate.Block([1, None], own)
    want = Counter((i, bool(block.matches(t, decontaminate.COVERAGE))) for i, t in texts())
    found = QUERIES["op2_decontamination"](spark, folder)
    assert Counter((r.doc_id, r.contaminated) for r in found.collect()) == want and want[(310, True)] == want[(311, True)] == 1


def test_blocks_of_the_benchmark(spark, folder, monkeypatch):
    """Several blocks, one after another, find what one block finds."""
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark").unionByName(spark.createDataFrame([(k, prose(k, 62)) for k in range(20, 30)], "item_id long, text string"))
    whole = rows_of(decontaminate.decontaminate(docs, items, keep=["doc_id", "_row"]).selectExpr("doc_id", "_row", "concat_ws(',', _items) AS i", "round(_coverage, 6) AS c"))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARACTERS", 900)
    cut = rows_of(decontaminate.decontaminate(docs, items, keep=["doc_id", "_row"]).selectExpr("doc_id", "_row", "concat_ws(',', _items) AS i", "round(_coverage, 6) AS c"))
    assert whole == cut and sum(whole.values()) == len(texts())


def test_token_ids_of_long_ids_and_nulls(spark, folder):
    t = Tokenizer.from_file(tokenizer_path())
    want = Counter((i, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x in texts())
    got = QUERIES["op3_token_records"](spark, folder).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    assert [r.start for r in sorted(got, key=lambda r: r.start)][0] == 0 and sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mixing_sizes_and_limits(spark, folder):
    got = QUERIES["op5_mixing"](spark, folder).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t in texts())
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    again = QUERIES["op5_mixing"](spark, folder).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_stages_keep_columns_and_decide(spark, folder):
    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        before, after = rows_of(docs), rows_of(out)
        assert set(after) <= set(before), name
        if name == "toxicity":
            gone = {r[0] for r in before - after}
            assert sum(200 <= (i or 0) < 240 for i in gone) >= 35 and sum(i is not None and i < 120 for i in gone) <= 3
        elif name == "near_duplicates":
            own = {r[:2]: shingles(r[1]) for r in before}
            kept = {r[:2] for r in after}
            for key, s in own.items():  # what was dropped has a like row that stays
                like = [k for k, o in own.items() if k[0] is not None and s and 100 * len(s & o) >= 75 * len(s | o)]
                assert key in kept or not s or any(k in kept for k in like), key
            for i, t in ((300, prose(3, 63)), (302, prose(5, 65))):
                assert (i, t) not in kept
            assert {k for k in own if k[0] is None} <= kept
        elif name == "decontamination":
            assert {r[0] for r in before - after} <= {310, 311}
            assert not {r[0] for r in after} & {310, 311}
        elif name == "mixing":
            assert all(n <= 2 for n in after.values())
            assert all(after[r] == 1 for r in before if not size(r[1]))
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_whole_pipeline(spark, folder, none):
    got = corpus_pipeline.run(spark, folder).collect()
    t = Tokenizer.from_file(tokenizer_path())
    by_id = {}
    for i, x in texts():
        ids = t.encode(x or "", add_special_tokens=False).ids + [END_ID]
        by_id.setdefault(i, set()).add((len(ids), zlib.crc32(b"".join(n.to_bytes(4, "little") for n in ids))))
    assert got and all((r.n_tokens, r.ids_crc32) in by_id[r.doc_id] for r in got)
    assert not {r.doc_id for r in got} & {300, 302, 310, 311}
    assert corpus_pipeline.run(spark, none).collect() == []
