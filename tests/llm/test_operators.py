"""Operators on odd rows and empty tables, and against brute force on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from crashlake.llm import chat, common, decontaminate, langid, minhash, mixing, quality, rules, substrings, suffix, token_records, toxicity
from crashlake.llm.queries import END_ID, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _copies string, key int"


def _prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("the of and was river stone house garden winter letter answer paper window quiet long".split()) + r.choice(["", "", "s", "ed"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = _prose(1, 120)
    long = _prose(2, 6000)
    odd = [(1, base), (2, base), (2, base), (3, base + " and more"), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "one two"), (9, long),
           (10, "12 34 %% ##"), (None, _prose(3, 30)), (11, _prose(4, 60)), (12, "É" * 900), (13, "é ü" * 300), (14, "a" * 401), (15, _prose(5, 200) + " idiot")]
    return [(i, t, "en" if t else None, "s1" if (i or 0) % 2 else None, len(t or ""), "x", 1) for i, t in odd]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _key(r):
    return tuple((x is not None, x) if not isinstance(x, list) else (True, x) for x in r)


def test_minhash_matches_all_pairs(docs, rows, empty):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    ids = [i for i in sets if i is not None]
    comp = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == comp.get(r.doc_id) and r.kept == (r.doc_id is None or comp[r.doc_id] == r.doc_id)
        assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_repeated_id_keeps_all_sets(spark):
    a, b = _prose(70, 80), _prose(71, 80)
    assert len(minhash.shingles(a)) == len(minhash.shingles(b))
    own = [(20, a), (20, b), (21, a + " more"), (22, b + " more")]
    got = minhash.near_duplicates(spark.createDataFrame(own, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {20}


def test_minhash_common_passage_with_surroundings_of_its_own_meets_nothing(spark, monkeypatch):
    # 96 shingles of each text are everybody's and 29 its own: a similarity of 0.62, the passage within the prefix
    passage = [f"p{i}" for i in range(100)]
    own = [(d, " ".join([f"d{d}w{i}" for i in range(25)] + passage)) for d in range(60)]
    names, stored = [], minhash.stored

    def spied(df, name):
        out = stored(df, name)
        names.append((name, out.count()))
        return out

    monkeypatch.setattr(minhash, "stored", spied)
    got = minhash.near_duplicates(spark.createDataFrame(own, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(d, d) for d in range(60)}
    assert [n for name, n in names if name == "prefix-keys" and n] and ("left-keys", 0) in names
    assert "centres" not in dict(names)


def test_minhash_near_copies_match_all_pairs(spark):
    r = random.Random(7)
    own = []
    for group in range(3):
        base = [f"g{group}p{i}" for i in range(90)]
        for _ in range(40):
            words = [w if r.random() > 0.03 else f"x{r.random()}" for w in base[r.randint(0, 9) : len(base) - r.randint(0, 9)]]
            own.append((len(own), " ".join(words + [f"y{r.random()}" for _ in range(r.randint(0, 12))])))
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for _, t in own]
    comp = list(range(len(own)))
    for a, x in enumerate(sets):
        for b in range(a):
            if 100 * len(x & sets[b]) >= 75 * len(x | sets[b]):
                low, high = sorted((comp[a], comp[b]))
                comp = [low if c == high else c for c in comp]
    assert 10 < len(set(comp)) < 110
    got = minhash.near_duplicates(spark.createDataFrame(own, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(comp))


def test_idle_workers_keep_no_word_hashes(spark, docs):
    minhash.near_duplicates(docs).count()

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(common._hashes)]})

    assert {r.n for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()} == {0}


def test_near_duplicates_stage_keeps_different_texts_of_one_id(spark):
    a, b = _prose(72, 80), _prose(73, 80)
    own = [(1, a, "x"), (1, b, "x"), (1, b.upper(), "x"), (2, a + " more", "x"), (3, b, "x"), (4, None, "x"), (4, "", "x"), (5, "", "x"), (None, a, "x"), (None, a, "x")]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(own, "doc_id long, text string, source string"), "")
    assert got.columns == ["doc_id", "text", "source"]
    kept = Counter((r.doc_id, (r.text or "").lower()) for r in got.collect())
    assert kept == {(1, a): 1, (1, b): 1, (4, ""): 1, (5, ""): 1, (None, a): 2}


def test_mixing_stage_gives_each_row_its_copies(spark):
    # rows alike in id and size: each its own copies, 2 at most; source t is taken 7/6 times
    own = [(None, f"w{i:03} b c", "s", i) for i in range(60)] + [(7, f"v{i:03} b c", "t", i) for i in range(90)] + [(None, "", "s", 0)]
    docs = spark.createDataFrame(own, "doc_id long, text string, source string, n int")
    got = Counter(r.text for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    assert max(got.values()) <= 2 and got.pop("") == 1
    want = {r.source: r.target for r in mixing.mix(docs).collect()}
    for s, c in (("s", "w"), ("t", "v")):
        assert abs(3 * sum(n for t, n in got.items() if t[0] == c) - want[s]) <= 3


def test_bitmaps_never_rule_out_what_is_shared():
    rng = np.random.default_rng(5)
    for size in (1, 2, 16, 17, 300, 1024, 1025):
        for part in (0, 0.5, 0.75, 0.9, 1):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            new = rng.integers(0, 1 << 63, int(size * (1.2 - part)) + 1, dtype=np.uint64)
            b = np.unique(np.concatenate([a[: int(size * part)], new]))
            most = minhash.most_common(len(a), minhash.bitmap(a), len(b), minhash.bitmap(b))
            assert len(np.intersect1d(a, b)) <= most <= min(len(a), len(b))


def test_substrings_match_brute_force(docs, rows, empty):
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(d[k : k + 400] for _, d in data for k in range(len(d) - 399))
    want = []
    for i, d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - 399):
            if seen[d[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        want.append((i, len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in substrings.dedup_substrings(docs).collect()]
    assert sorted(got, key=_key) == sorted(want, key=_key)
    assert substrings.dedup_substrings(empty).count() == 0


def test_hot_anchors_give_the_same(docs, monkeypatch):
    want = sorted((tuple(r) for r in substrings.dedup_substrings(docs).collect()), key=_key)
    monkeypatch.setattr(substrings, "HOT", 1)
    assert sorted((tuple(r) for r in substrings.dedup_substrings(docs).collect()), key=_key) == want


def test_suffix_array_and_prefixes():
    pieces = [b"banana", b"ananas", b"", b"banana", b"nnnnnn"]
    text, starts = suffix.joined(pieces)
    order = suffix.suffix_array(text)
    symbols = text.tolist()
    assert order.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])
    common = suffix.common_prefixes(text, order)
    for k in range(1, len(order)):
        a, b = symbols[order[k - 1] :], symbols[order[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert common[k] == n
    hit, _ = suffix.found_in(text, np.arange(3), text, order, 4)
    assert hit.all()


def test_shards_merge_by_binary_search():
    same, other = b"x" * 10 + bytes(range(200)) * 3, bytes(range(1, 201)) * 3
    a, b = substrings._Shard([(1, 11, 410, 0, same[:410])]), substrings._Shard([(1, 12, 425, 0, same[5:430]), (2, 13, 600, 0, other)])
    b.merge(a, 1)
    assert [x[2:] for x in a.spans()] == [(5, 10)]
    assert (12, 425, 0, 5) in list(b.spans())


def test_records_round_trip(docs, rows, empty, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    extra = [(90, "a  b \n c\n\nd  "), (91, "don't <|endoftext|> x!!, y.\u0085z"), (92, " x\0y ")]
    own = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    records = token_records.write_records(own, tokenizer_path(), END_ID, shards=3)
    got = records.read().orderBy("start").collect()
    texts = [(i, x) for i, x, *_ in rows] + extra
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((i is not None, i or 0) for i, _ in texts)
    start, by_id = 0, {}
    for i, x in texts:
        by_id.setdefault(i, []).append(t.encode(x or "", add_special_tokens=False).ids + [END_ID])
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == start and ids in by_id[r.doc_id] and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(r.ids)
        start += r.n_tokens
    shuffled = records.read(seed=7).collect()
    assert sorted(r.start for r in shuffled) == [r.start for r in got]
    assert token_records.write_records(empty, tokenizer_path()).read().count() == 0


def test_damaged_records_are_found():
    good = token_records.frame(b"abc")
    assert token_records.unframe(good) == b"abc"
    for k in range(len(good)):
        with pytest.raises(ValueError):
            token_records.unframe(good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :])


def test_mixing_targets_and_copies(docs, rows, empty, spark):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs).collect()
    assert sorted(map(tuple, got), key=_key) == sorted(map(tuple, again), key=_key)
    assert len(got) == len(rows) and all(0 <= r.copies <= 2 for r in got if r.size) and all(r.copies == 0 for r in got if not r.size)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= max(r.size for r in own)
    total = sum(r.size for r in got)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * total)
    assert mixing.mix(empty).count() == 0
    many = spark.range(40_000).selectExpr("id as doc_id", "repeat('w ', int(1 + id % 7)) as text", "if(id % 3 = 0, 'hot', 'x') as source")
    for r in mixing.mix(many).groupBy("source", "target").agg({"*": "count"}).collect():
        assert r["count(1)"] > 0
    sums = mixing.mix(many).selectExpr("source", "target", "size * copies as t").groupBy("source", "target").agg({"t": "sum"}).collect()
    assert all(abs(r["sum(t)"] - r["target"]) <= 7 for r in sums)


def test_pivot_keeps_expectations():
    size, part = np.array([3.0, 5.0, 2.0, 9.0]), np.array([0.2, 0.5, 0.7, 0.4])
    mean = np.zeros(4)
    for k in range(4000):
        r = np.random.default_rng(k)
        out, left = mixing.pivot(size, part, r)
        assert (out * size).sum() == pytest.approx((part * size).sum())
        assert sum(0 < x < 1 for x in out) <= 1 and all(x in (0, 1) or i == left for i, x in enumerate(out))
        mean += out / 4000
    assert mean == pytest.approx(part, abs=0.03)


def test_rules_counts(docs, rows, empty):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    got = {}
    for r in rules.judged(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in rows:
        w = word.findall(t or "")
        at = {}
        for k in range(len(w) - 7):
            at.setdefault(tuple(w[k : k + 8]), []).append(k)
        cover = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if word.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover))
        r = got[i][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert rules.judged(empty).count() == 0


def test_chat_collapse(spark):
    turns = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (3, 1, "assistant", "yes"),
             (4, 0, "user", "other"), (5, 0, None, None), (None, 0, "user", "hi"), (6, 300, "user", "late"), (6, 0, "user", "early")]
    got = chat.render(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    want = {(2, 0): 2, (4, 0): 1, (5, 0): 1, (6, 0): 2}  # parts go by place, not by turn number
    assert {(r.conv_id, r.part): r.n_turns for r in got} == want
    two = next(r for r in got if r.conv_id == 2)
    assert two.rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string, pos int")).count() == 0


def test_chat_parts_of_turns_without_id(spark):
    """A third of the turns has no conv_id and one turn number; its parts hold `PART` turns each, in order."""
    n = 3 * chat.PART - 10
    turns = [(None, None, "user", f"t{i:04d}") for i in range(n)] + [(c, t, "user", f"c{c} {t}") for c in range(2 * n // 5) for t in range(5)]
    got = chat.render(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(7)).collect()
    own = sorted((r.part, r.rendered) for r in got if r.conv_id is None)
    assert [x.count("<|im_start|>") for _, x in own] == [chat.PART, chat.PART, chat.PART - 10]
    assert re.findall("t[0-9]{4}", "".join(x for _, x in own)) == [f"t{i:04d}" for i in range(n)]
    assert len(got) == 3 + 2 * n // 5


def test_tiles_and_contamination(docs, empty, spark):
    item = _prose(50, 40)
    w = item.split()
    leaks = [(1, "x y z " + item + " z"), (2, " ".join(w[20:] + ["cut", "here"] + w[:20])), (3, _prose(51, 80)), (4, None), (5, " ".join(w[:12]))]
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "zebra quagga okapi")], "item_id long, text string")
    own = spark.createDataFrame(leaks, "doc_id long, text string")
    got = {r.doc_id: list(r._items) for r in decontaminate.decontaminate(own, bench).collect()}
    assert got == {1: [7], 2: [7], 3: [], 4: [], 5: []}
    a, b = decontaminate.tokens(item), decontaminate.tokens(leaks[1][1])
    tiles = decontaminate.tile(a, b)
    assert sum(n for *_, n in tiles) == 40
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert all(not r._items for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())


def test_toxicity_neighbours_are_exact(docs, empty, spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 64)  # several blocks of the few examples here
    r = random.Random(5)
    vocabulary = {f"w{i}": 5 + i for i in range(30)}
    examples = [(i, r.random() < 0.3, Counter(r.choices(list(vocabulary), k=r.randint(1, 6)))) for i in range(600)]
    index = toxicity.build(examples, vocabulary, 700)
    for _ in range(50):
        q = index.vector(" ".join(r.choices(["wx", *(t for t in vocabulary)], k=4)).replace("w", "w"))
        scores = sorted(((sum(w * v.get(t, 0.0) for t, w in q.items()), i) for i, v in enumerate(index.vectors)), key=lambda x: (-x[0], x[1]))
        near = index.nearest(q)
        assert [s for s, _ in near] == pytest.approx([s for s, _ in scores[: len(near)]])
    words = [(i, ("idiot trash " if i % 4 == 0 else "") + _prose(i, 30)) for i in range(300)]
    known = spark.createDataFrame(words, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    index = toxicity.train(toxicity.labelled_rows(known, labels, F.lit(True)))
    got = {r.doc_id: r._toxicity for r in toxicity.score(known, index).collect()}
    assert all((got[i] >= 0.3) == (i % 4 == 0) for i in got)
    assert toxicity.score(docs, index).columns == [*docs.columns, "_toxicity", "_evidence"] and toxicity.score(docs, index).count() == docs.count()
    none = toxicity.train(toxicity.labelled_rows(empty, labels.limit(0), F.lit(True)))
    assert {r._toxicity for r in toxicity.score(docs, none).collect()} == {0.0}


def test_toxicity_learns_rare_terms(spark):
    from pyspark.sql import functions as F

    # eight toxic rows of 70, each toxic word in four of them
    texts = [(i, _prose(i, 30) + (" bocoa" if i < 4 else " bocob" if i < 8 else "")) for i in range(70)]
    known = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 8)) for i in range(70)], "doc_id long, toxic int")
    index = toxicity.train(toxicity.labelled_rows(known, labels, F.lit(True)))
    assert {"bocoa", "bocob"} <= set(index.idf)
    new = spark.createDataFrame([(100, _prose(100, 30) + " bocoa"), (101, "bocob"), (102, _prose(101, 30))], "doc_id long, text string")
    got = {r.doc_id: r._toxicity >= toxicity.THRESHOLD for r in toxicity.score(new, index).collect()}
    assert got == {100: True, 101: True, 102: False}


def test_quality_learns_pairs(docs, spark):
    r = np.random.default_rng(3)
    x = r.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (0, 1) in {(a, b) for a, b, _ in model.pairs}
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    got = quality.score(docs, quality.fit(np.empty((0, len(quality.FEATURES))), np.empty(0))).collect()
    assert {r._quality for r in got} == {0.5}


def test_language(docs, empty, spark):
    from pyspark.sql import functions as F

    texts = [("de", "der die und das Straße gehen über"), ("en", "the house of the winter and this"), ("fr", "le château été où français les")] * 20
    own = spark.createDataFrame([(i, f"{t} {t[: i % 9]}", k) for i, (k, t) in enumerate(texts)], "doc_id long, text string, lang string")
    got = langid.identify(own, langid.train(own), F.lit(False)).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)] == [k for k, _ in texts]
    odd = langid.identify(docs, langid.train(own), F.lit(True)).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert {r.lang_pred for r in odd if r.doc_id in (4, 5, 6, 10)} == {"und"}
    assert langid.identify(empty, langid.train(empty), F.lit(True)).count() == 0
