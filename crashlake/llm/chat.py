"""Chat formatting of logged conversations, cumulative snapshots collapsed first.

A conversation that is logged again after each turn appears once for every
length.  Each turn gets the hash of the conversation up to it: a running sum of
two 64-bit hashes of (position, role, text).  A conversation whose last hash is
another's hash at the same length is a prefix of that one; an anti-join removes
these, and of equal conversations all but the smallest id.  What is left is
rendered, one row for each part of at most `PART` turns.

Turns are numbered by a range-partitioned sort, and running sums are taken
within a partition and then over the partitions' totals, so a conversation with
very many turns, or rows without an id or turn number, are spread over many
tasks; shared beginnings are combined before the shuffle.  DataFrame functions
only.

Defined cases: a null role is "unknown" and a null text empty, also when
conversations are compared; a repeated row (equal in conv_id, turn, role and
text) counts once; different rows with one turn number are ordered by role and
text; null turns come first; rows without a conv_id are one conversation, whose
id sorts before all others; an empty table gives an empty result; other
columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crashlake.llm.common import in_order

PART = 256
#: Characters of a text that partitions are cut by; longer ones only matter within one.
DEALT = 200
BEGIN, END = "<|im_start|>", "<|im_end|>"


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, part, pos (from 1), _n (turns) and the prefix hashes _h and _g of each turn."""
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    dealt = [F.col("turn"), F.col("role"), F.substring("text", 1, DEALT)]
    rows, pieces = in_order(rows, ["conv_id"], ["turn", "role", "text"], "chat-turns", dealt)
    pieces = pieces.withColumnsRenamed({"conv_id": "_c", "_pid": "_p"})
    here = lambda own: rows["conv_id"].eqNullSafe(own["_c"]) & (rows["_pid"] == own["_p"])
    rows = rows.join(pieces, here(pieces)).withColumn("pos", F.col("_at") + F.col("_shift") + 1).withColumnRenamed("_total", "_n").drop("_c", "_p", "_at", "_shift")
    mark = lambda seed: F.xxhash64(F.lit(seed), "pos", "role", "text").cast("decimal(20,0)")
    rows = rows.withColumns({"part": F.floor((F.col("pos") - 1) / PART), "_h": mark(1), "_g": mark(2)})
    # running sums within a conversation's piece of a partition, and over its pieces, of which there are few
    sums = rows.groupBy("conv_id", "_pid").agg(F.sum("_h").alias("_h0"), F.sum("_g").alias("_g0"))
    before = Window.partitionBy("conv_id").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    total = lambda c: F.coalesce(F.sum(c).over(before), zero).cast("decimal(38,0)").alias(c)
    sums = sums.select(F.col("conv_id").alias("_c"), F.col("_pid").alias("_p"), total("_h0"), total("_g0"))
    rows = rows.join(sums, here(sums))
    upto = Window.partitionBy("conv_id", "_pid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = lambda c, c0: (F.col(c0) + F.sum(c).over(upto)).cast("decimal(38,0)")
    return rows.withColumns({"_h": running("_h", "_h0"), "_g": running("_g", "_g0")}).drop("_h0", "_g0", "_c", "_p", "_pid")


def collapsed(conversations: DataFrame) -> DataFrame:
    """The turns (as of `prefixes`) of conversations that aren't the beginning of another."""
    turns = prefixes(conversations)
    whole = F.col("pos") == F.col("_n")
    # a struct of "has an id" and the id orders a missing id first
    name = F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id")
    shared = turns.groupBy("pos", "_h", "_g").agg(F.max("_n").alias("_longest"), F.min(F.when(whole, name)).alias("_first"))
    shared = shared.where(F.col("_first").isNotNull())
    last = turns.where(whole).select("pos", "_h", "_g", "conv_id", name.alias("_name"))
    beaten = last.join(shared, ["pos", "_h", "_g"]).where((F.col("_longest") > F.col("pos")) | (F.col("_first") < F.col("_name")))
    beaten = beaten.select(F.col("conv_id").alias("_c"))
    return turns.join(beaten, turns["conv_id"].eqNullSafe(beaten["_c"]), "left_anti")


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, part, n_turns (of the conversation) and rendered, for each part of the maximal conversations."""
    piece = F.concat(F.lit(BEGIN), F.col("role"), F.lit("\n"), F.col("text"), F.lit(END + "\n"))
    turns = collapsed(conversations).select("conv_id", "part", "_n", F.struct("pos", piece.alias("s")).alias("_t"))
    parts = turns.groupBy("conv_id", "part", "_n").agg(F.sort_array(F.collect_list("_t")).alias("_t"))
    return parts.select("conv_id", "part", F.col("_n").alias("n_turns"), F.array_join(F.col("_t.s"), "").alias("rendered"))


ORACLE = f"""
with t as (select distinct conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations),
p as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos,
             count(*) over (partition by conv_id) as n,
             (row_number() over (partition by conv_id order by turn nulls first, role, text) - 1) // {PART} as part from t),
l as (select *, list(row(role, text)) over (partition by conv_id order by pos) as upto from p),
f as (select conv_id, n, upto from l where pos = n),
b as (select distinct f.conv_id from f join l on l.upto = f.upto
      where l.n > f.n or (l.n = f.n and (l.conv_id < f.conv_id or (l.conv_id is null and f.conv_id is not null))))
select conv_id, part, n as n_turns,
       string_agg('{BEGIN}' || role || chr(10) || text || '{END}' || chr(10), '' order by pos) as rendered
from p where not exists (select 1 from b where b.conv_id is not distinct from p.conv_id)
group by conv_id, part, n
"""
