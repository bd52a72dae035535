"""Scale-safe numbering helpers against plain Python sorting."""

import random

from pyspark.sql import functions as F

from crashlake.operators.rank import sorted_index
from crashlake.operators.sequence import global_index, left_join_nonnull, running_sum


def test_sorted_index_matches_python_sort(spark):
    random.seed(3)
    rows = [(i, random.randint(1, 4), random.randint(1, 50), random.choice(["a", "b"])) for i in range(30000)]
    df = spark.createDataFrame(rows, "ord long, sev int, dup int, grp string").repartition(16)
    order = [F.col("sev").desc(), F.col("dup").desc(), F.col("ord").asc()]
    got = {r.ord: r.rank for r in sorted_index(df, order).collect()}
    want = sorted(rows, key=lambda r: (-r[1], -r[2], r[0]))
    assert [got[r[0]] for r in want] == list(range(1, len(rows) + 1))
    per_group = {r.ord: r.rank for r in sorted_index(df, order, ["grp"]).collect()}
    for g in ("a", "b"):
        ws = [r for r in want if r[3] == g]
        assert [per_group[r[0]] for r in ws] == list(range(1, len(ws) + 1))


def test_block_index_and_running_sum(spark):
    rows = [(f"i{k}", n, n % 3) for k in range(3) for n in range(5000)]
    df = spark.createDataFrame(rows, "inst string, line long, v long").repartition(8)
    idx = {(r.inst, r.line): r.idx for r in global_index(df, ["inst"], "line", "idx").collect()}
    assert [idx[(i, n)] for i, n, _ in sorted(rows)] == list(range(len(rows)))
    one = df.where(F.col("inst") == "i0")
    rs = {r.line: r.cum for r in running_sum(one, "line", "v", "cum", block=333).collect()}
    acc = 0
    for n in range(5000):
        acc += n % 3
        assert rs[n] == acc


def test_left_join_nonnull_keeps_null_keys(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, k string")
    right = spark.createDataFrame([("a", 10), ("c", 30)], "k string, v long")
    out = {r.id: r.v for r in left_join_nonnull(left, right, ["k"]).collect()}
    assert out == {1: 10, 2: None, 3: 30}
