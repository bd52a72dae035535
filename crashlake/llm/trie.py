"""Prefix trie of conversations by SQL ROLLUP over positional turn-id columns.

A turn's id is a digest of its role and text.  The ids of `BLOCK` consecutive
turns are the columns c1 to c8 of one row, so a single `GROUP BY key, block,
ROLLUP (c1, ..., c8)` aggregates all prefixes that end in that block, and
`grouping_id` tells their depth.  Longer conversations go on in further blocks
(rows), grouped below the key of the node that the block before ends in.  That
key is a digest of all blocks before, chained in runs of `RUN` blocks, and runs
of runs for very long conversations, so no conversation is gathered whole.

Subtree sums come from a second ROLLUP.  Each node is told to its smallest
member, whose rows then carry, for every position, what that conversation
answers for from there on (tokens saved, or being the first at a leaf); summed
over the members of a node that is the sum over its subtree.

The digest of the conversations that end in a node is taken of their ids in
order: they are numbered by a range-partitioned sort and joined to texts of at
most `CHUNK` ids.  SHA-256 reads a text front to back, so a node in which very
many conversations end has its chunks streamed through one task, one at a time.

Defined cases: a null role or text counts as empty; turns of one number are
ordered by their digests, null numbers first, and repeated rows are turns of
their own; rows without a conversation id belong to none and are left out; a
conversation may have no turns and is then a member of the root alone; texts of
any length are reduced to a digest and a word count in the JVM; an empty table
gives an empty result; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashlake.llm.common import discard, in_order, placed, stored
from crashlake.llm.mixing import word_count

BLOCK = 8
RUN = 256
CHUNK = 4096
_COLUMNS = [f"c{i}" for i in range(1, BLOCK + 1)]
_EMPTY = b""


def digest(*parts: Column) -> Column:
    """16 bytes of the SHA-256 of binary parts."""
    return F.substr(F.unhex(F.sha2(F.concat(*parts), 256)), F.lit(1), F.lit(16))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, id and words of each turn that has a conversation id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where(F.col("conv_id").isNotNull())
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), own.alias("id"), word_count().alias("words"))


def with_shared_heads(conversations: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of conversation c - c % `every`; h is crc32(c) % `most`.

    Returns conv_id, pos, id, words of the turns, and conv_id of all conversations.
    """
    rows, parts = in_order(turns_of(conversations), ["conv_id"], ["turn", "id"], "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = F.col("conv_id") - F.col("conv_id") % every
    first = F.col("conv_id") % every == 0
    begins = placed(rows.where(first), parts.where(first), ["conv_id"]).where(F.col("pos") < most - 1)
    begins = begins.groupBy(F.col("conv_id").alias("_b")).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "words"))).alias("_head"))
    convs = parts.select("conv_id").distinct().select("conv_id", h.cast("int").alias("_h"), base.alias("_base"))
    head = F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), F.array().cast("array<struct<pos:bigint,id:binary,words:bigint>>"))
    convs = convs.join(begins, F.col("_base") == F.col("_b"), "left").select(F.col("conv_id").alias("_c"), "_h", head.alias("_head"))
    convs = stored(convs, "conversation-heads")
    own_parts = parts.join(convs.select("_c", "_h", F.size("_head").alias("_m")), F.col("conv_id") == F.col("_c")).drop("_c")
    own = placed(rows, own_parts, ["conv_id"]).where(F.col("pos") >= F.col("_h"))
    own = own.select("conv_id", (F.col("pos") - F.col("_h") + F.col("_m")).alias("pos"), "id", "words")
    return convs.select(F.col("_c").alias("conv_id"), F.inline("_head")).unionByName(own), convs.select(F.col("_c").alias("conv_id"))


def _chained(steps: DataFrame) -> DataFrame:
    """conv_id, idx, before, after, last: digests of what comes before each step (conv_id, idx, digest), and with it; `last` of its conversation."""
    runs = steps.groupBy("conv_id", F.floor(F.col("idx") / RUN).alias("run")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("_s"))
    chain = F.aggregate("_s", F.array(F.lit(_EMPTY)), lambda done, s: F.concat(done, F.array(digest(F.element_at(done, -1), s["digest"]))))
    runs = runs.withColumn("_chain", chain)
    at = F.col("_i")
    inner = runs.select("conv_id", "run", F.size("_s").alias("_n"), "_chain", F.posexplode("_s").alias("_i", "_step")).select(
        "conv_id", "run", at, F.col("_step.idx").alias("idx"), F.get("_chain", at).alias("before"), F.get("_chain", at + 1).alias("after"), (at + 1 == F.col("_n")).alias("last"),
    )
    if (steps.agg(F.max("idx")).first()[0] or 0) < RUN:
        return inner.drop("run", "_i")
    outer = stored(_chained(runs.select("conv_id", F.col("run").alias("idx"), F.element_at("_chain", -1).alias("digest"))), "runs")
    outer = outer.select(F.col("conv_id").alias("_c"), F.col("idx").alias("_r"), F.col("before").alias("_b"), F.col("after").alias("_a"), F.col("last").alias("_l"))
    both = inner.join(outer, (F.col("conv_id") == F.col("_c")) & (F.col("run") == F.col("_r")))
    # a full run ends where the next one begins
    after = F.when(at + 1 == RUN, digest(F.col("_a"))).otherwise(F.when(F.length("after") > 0, digest(F.col("_b"), F.col("after"))))
    before = F.when(at == 0, digest(F.col("_b"))).otherwise(digest(F.col("_b"), F.col("before")))
    return both.select("conv_id", "idx", before.alias("before"), after.alias("after"), (F.col("last") & F.col("_l")).alias("last"))


def _later(rows: DataFrame) -> DataFrame:
    """conv_id, idx, later: the sum of `v` over the conversation's rows of larger idx."""
    run = F.floor(F.col("idx") / RUN).alias("run")
    after = Window.partitionBy("conv_id", "run").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    inner = rows.select("conv_id", "idx", "v", run).withColumn("later", F.coalesce(F.sum("v").over(after), F.lit(0)))
    if (rows.agg(F.max("idx")).first()[0] or 0) < RUN:
        return inner.select("conv_id", "idx", "later")
    outer = _later(rows.groupBy("conv_id", run).agg(F.sum("v").alias("v")).withColumnRenamed("run", "idx"))
    outer = outer.select(F.col("conv_id").alias("_c"), F.col("idx").alias("_r"), F.col("later").alias("_more"))
    both = inner.join(outer, (F.col("conv_id") == F.col("_c")) & (F.col("run") == F.col("_r")))
    return both.select("conv_id", "idx", (F.col("later") + F.col("_more")).alias("later"))


def blocks_of(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conversation and block: conv_id, block, key, c1 to c8 (null after its end), size, last.

    A column is a struct of turn id and words; that of the last one also has the next block's key.
    """
    slot = (F.col("pos") % BLOCK).cast("int").alias("slot")
    rows = turns.groupBy("conv_id", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct(slot, "id", "words"))).alias("_t"))
    rows = stored(rows, "blocks")
    own = F.concat(*(F.coalesce(F.get("_t", F.lit(i))["id"], F.lit(_EMPTY)) for i in range(BLOCK)))
    chained = _chained(rows.select("conv_id", F.col("block").alias("idx"), digest(own).alias("digest")))
    chained = chained.select(F.col("conv_id").alias("_c"), F.col("idx").alias("_b"), F.col("before").alias("key"), F.col("after").alias("_after"), "last")
    rows = rows.join(chained, (F.col("conv_id") == F.col("_c")) & (F.col("block") == F.col("_b")))
    turn = [F.get("_t", F.lit(i)) for i in range(BLOCK)]
    kinds = ["struct<id:binary,words:bigint>"] * (BLOCK - 1) + ["struct<id:binary,words:bigint,next:binary>"]
    own = [F.struct(t["id"].alias("id"), t["words"].alias("words"), *([F.col("_after").alias("next")] if i == BLOCK - 1 else [])) for i, t in enumerate(turn)]
    columns = [F.when(t.isNotNull(), s).cast(k).alias(c) for t, s, k, c in zip(turn, own, kinds, _COLUMNS, strict=True)]
    full = stored(rows.select("conv_id", "block", "key", *columns, F.size("_t").alias("size"), "last"), "block-rows")
    root = full.where("block = 0").limit(1).select("key").first()
    bare = conversations.join(rows.where("block = 0").select("conv_id"), "conv_id", "left_anti").select(
        "conv_id", F.lit(0).cast("long").alias("block"), F.lit(bytes(root["key"]) if root else _EMPTY).alias("key"),
        *(F.lit(None).cast(k).alias(c) for k, c in zip(kinds, _COLUMNS, strict=True)), F.lit(0).alias("size"), F.lit(True).alias("last"),
    )
    return full.unionByName(bare)


def node_id(level: Column) -> Column:
    """Key of the node at a level of a block, from its columns."""
    below = F.concat(F.col("key"), *(F.when(level >= i + 1, F.coalesce(F.col(c)["id"], F.lit(_EMPTY))).otherwise(F.lit(_EMPTY)) for i, c in enumerate(_COLUMNS)))
    return F.when(level == 0, F.col("key")).when(level == BLOCK, F.col(_COLUMNS[-1])["next"]).otherwise(digest(below))


def rolled_up(rows: DataFrame, sums: list[str]) -> DataFrame:
    """nid, parent, depth, conv_id, n_convs, words and the aggregates `sums` of every node."""
    columns = ", ".join(_COLUMNS)
    more = "".join(f", {s}" for s in sums)
    grouped = rows.sparkSession.sql(
        f"SELECT key, block, {columns}, {BLOCK} - bit_count(grouping_id()) AS level, min(conv_id) AS conv_id, count(*) AS n_convs{more} "
        f"FROM {{rows}} GROUP BY key, block, ROLLUP ({columns})",
        rows=rows,
    )
    level = F.col("level")
    last = F.coalesce(*(F.when(level == i + 1, F.col(c)["words"]) for i, c in enumerate(_COLUMNS)))
    # a level beyond a conversation's end is none of its prefixes, and the empty prefix of a later block ended the one before
    real = ((level == 0) & (F.col("block") == 0)) | F.coalesce(*(F.when(level == i + 1, F.col(c).isNotNull()) for i, c in enumerate(_COLUMNS)), F.lit(False))
    return grouped.where(real).select(
        node_id(level).alias("nid"), F.when(level > 0, node_id(level - 1)).alias("parent"), (F.col("block") * BLOCK + level).alias("depth"),
        "conv_id", "n_convs", F.coalesce(last, F.lit(0)).alias("words"), *(s.rsplit(" AS ", 1)[1] for s in sums),
    )


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(nid, ends_sha256) of rows (nid, chunk, text) sorted by nid and chunk."""
    last, state = None, None
    done: list[tuple[bytes, str]] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["nid", "ends_sha256"])

    for batch in batches:
        for nid, text in zip(batch.column(0), batch.column(2), strict=True):
            own = nid.as_py()
            if own != last:
                if state is not None:
                    done.append((last, state.hexdigest()))
                last, state = own, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.as_py().encode())
        yield out()
        done.clear()
    if state is not None:
        done.append((last, state.hexdigest()))
        yield out()


def end_digests(ends: DataFrame) -> DataFrame:
    """nid and the SHA-256 of the ascending, comma-joined ids of the conversations that end there (nid, conv_id)."""
    rows, parts = in_order(ends, ["nid"], ["conv_id"], "ends")
    at = placed(rows, parts, ["nid"])
    texts = at.groupBy("nid", F.floor(F.col("pos") / CHUNK).alias("chunk"), "_total").agg(F.sort_array(F.collect_list("conv_id")).alias("_c"))
    texts = texts.select("nid", "chunk", F.array_join(F.col("_c").cast("array<string>"), ",").alias("text"), "_total")
    short = texts.where(F.col("_total") <= CHUNK).select("nid", F.sha2("text", 256).alias("ends_sha256"))
    long = texts.where(F.col("_total") > CHUNK).select("nid", "chunk", "text").repartition("nid").sortWithinPartitions("nid", "chunk")
    return short.unionByName(long.mapInArrow(_streamed, "nid binary, ends_sha256 string"))


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations' turns (conv_id, pos from 0, id, words).

    conversations: conv_id of all, also those without a turn.  Columns: conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (words of members beyond the first, summed over the subtree),
    ends_sha256, and the node's key `nid`.
    """
    rows = stored(blocks_of(turns, conversations), "trie-rows")
    nodes = stored(rolled_up(rows, []), "trie-nodes")
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("_n")).agg(F.count("*").alias("n_children"))
    children = stored(children, "trie-children")
    leaves = nodes.join(children, F.col("nid") == F.col("_n"), "left_anti").select(F.col("conv_id").alias("_leaf"))

    weights = nodes.where((F.col("n_convs") > 1) & (F.col("words") > 0)).select(
        "conv_id", F.floor((F.col("depth") - 1) / BLOCK).alias("block"), ((F.col("depth") - 1) % BLOCK).cast("int").alias("slot"), ((F.col("n_convs") - 1) * F.col("words")).alias("w"),
    )
    weights = weights.groupBy(F.col("conv_id").alias("_c"), F.col("block").alias("_b")).agg(F.collect_list(F.struct("slot", "w")).alias("_w"))
    own = rows.join(weights, (F.col("conv_id") == F.col("_c")) & (F.col("block") == F.col("_b")), "left").drop("_c", "_b")
    own = own.join(leaves, F.col("conv_id") == F.col("_leaf"), "left").withColumn("leaf", F.col("_leaf").isNotNull().cast("long")).drop("_leaf")
    upto = lambda i: F.coalesce(F.aggregate(F.filter("_w", lambda x: x["slot"] >= i), F.lit(0).cast("long"), lambda a, x: a + x["w"]), F.lit(0))
    weighted = stored(own.select("*", *(upto(i).alias(f"s{i + 1}") for i in range(BLOCK))).drop("_w"), "trie-weights")
    later = _later(weighted.select("conv_id", F.col("block").alias("idx"), F.col("s1").alias("v")))
    later = later.select(F.col("conv_id").alias("_c"), F.col("idx").alias("_b"), "later")
    own = weighted.join(later, (F.col("conv_id") == F.col("_c")) & (F.col("block") == F.col("_b"))).drop("_c", "_b")
    sums = ["sum(leaf) AS n_leaves", *(f"sum(s{i + 1} + later) AS s{i + 1}" for i in range(BLOCK))]
    full = rolled_up(own, sums)
    level = F.when(F.col("depth") > 0, (F.col("depth") - 1) % BLOCK + 1).otherwise(1)
    saved = F.coalesce(*(F.when(level == i + 1, F.col(f"s{i + 1}")) for i in range(BLOCK)))

    final = rows.where("last").select(node_id(F.col("size")).alias("nid"), "conv_id")
    ends = end_digests(final).withColumnRenamed("nid", "_e")
    parents = nodes.select(F.col("nid").alias("_p"), F.col("conv_id").alias("parent_conv_id"))
    full = full.select("nid", "parent", "conv_id", "depth", "n_convs", "n_leaves", saved.alias("saved_tokens"))
    out = full.join(children, F.col("nid") == F.col("_n"), "left").join(ends, F.col("nid") == F.col("_e"), "left").join(parents, F.col("parent") == F.col("_p"), "left")
    out = stored(out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "nid",
    ), "trie")
    discard(rows, nodes, children, weighted)
    return out
