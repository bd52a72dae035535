"""Merkle manifest of a dataset, with a proof for every row by pointer jumping.

Each row is a leaf: the SHA-256 of its fields.  The leaves of a group (`lang`),
ascending by id, are paired level by level up to the group's subroot, and the
subroots, ascending by group, likewise up to the root; a last node without a
partner is hashed alone.

Positions come from a range-partitioned sort, so a group with a third of all
rows is spread like any other.  `SPAN` levels are built in one step from runs
of 2^SPAN consecutive nodes, in array functions.  Groups that are lower than
the highest are extended by steps that hash nothing, so a level number means
the same distance from the root in all of them.

Every node below the root starts with a pointer to its parent and a segment:
its sibling and the side it is on.  A round joins each node that is still
needed to the node its pointer names, appends that one's segment and takes over
its pointer, so the distance doubles until each leaf points to the root; its
segment is then the whole proof.  After round r only nodes of levels that 2^r
divides are needed.  Where a round has few distinct targets they are a bounded
number of rows and are broadcast, so many leaves under one target don't meet in
a task.

Defined cases: a null field is `-`, so nulls and empty texts differ; a null
group is a group of its own, the first; null ids come first; rows of equal ids
are ordered by their digests, and equal rows are leaves of their own; a lone
leaf is its subroot and a lone subroot the root, with an empty proof; texts of
any length are hashed whole in the JVM; an empty table gives an empty result;
columns other than the hashed ones aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashlake.llm.common import discard, in_order, placed, stored

SPAN = 8
#: A segment is a run of entries: a byte for the sibling's side and its 32-byte digest (zeros if it has none).
ENTRY = 33
ALONE, LEFT, RIGHT = b"\0", b"\1", b"\2"
#: Targets of a round up to this number are broadcast (a few MB at most); a join on more targets spreads well.
FEW = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(columns: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def text_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest_of(*digests: Column) -> Column:
    """Digest of digests, as hex text."""
    return F.unhex(F.sha2(F.concat(*map(text_of, digests)), 256))


def height(n: Column) -> Column:
    """Levels above `n` leaves: the least h with 2^h >= n."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("int")


def _pairs(below: Column) -> Column:
    """Digests of the pairs of consecutive nodes; a last one without a partner is hashed alone."""

    def pair(i: Column) -> Column:
        first, second = F.get(below, 2 * i), F.get(below, 2 * i + 1)
        return F.when(2 * i + 1 < F.size(below), digest_of(first, second)).otherwise(digest_of(first))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(below) - 1) / 2).cast("int")), pair)


def _described(own: Column, level: int, shift: int, top: Column, nodes: DataFrame, leaves: bool) -> Column:
    """level, pos, seg, digest and leaf of the digests `own` of one level of a run."""

    def node(d: Column, i: Column) -> Column:
        right = F.when(i + 1 < F.size(own), F.concat(F.lit(RIGHT), F.get(own, i + 1))).otherwise(F.lit(ALONE + bytes(ENTRY - 1)))
        seg = F.when(F.pmod(i, F.lit(2)) == 1, F.concat(F.lit(LEFT), F.get(own, i - 1))).otherwise(right)
        leaf = F.get(F.col("_n"), i)["leaf"] if leaves else F.lit(None).cast(nodes.schema["leaf"].dataType)
        return F.struct(
            F.lit(level).alias("level"), (F.shiftleft(F.col("_run"), shift) + i).alias("pos"),
            F.when(~top, seg).alias("seg"), F.when(top, d).alias("digest"), leaf.alias("leaf"),
        )

    return F.transform(own, node)


def _span(nodes: DataFrame, base: int) -> DataFrame:
    """`SPAN` levels at once: nodes are tree, pos, digest, total (nodes of that tree at level `base`) and leaf
    (what a leaf carries, else null).

    Returns tree, total, level, pos, seg, digest and leaf of the nodes on these
    levels; a node that goes on, or a tree's top, has a digest in place of a segment.
    """
    at = F.shiftright("pos", SPAN)
    runs = nodes.groupBy("tree", at.alias("_run"), "total").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "leaf"))).alias("_n"))
    runs = runs.withColumn("_l0", F.transform("_n", lambda x: x["digest"]))
    up = height(F.col("total"))
    for k in range(SPAN):
        above = F.when((up > k) & (F.size(f"_l{k}") > 0), _pairs(F.col(f"_l{k}"))).otherwise(F.array().cast("array<binary>"))
        runs = runs.withColumn(f"_l{k + 1}", above)
    out = [_described(F.col(f"_l{k}"), base + k, SPAN - k, F.lit(k == SPAN) | (up <= k), nodes, k == 0) for k in range(SPAN + 1)]
    return runs.select("tree", "total", F.inline(F.concat(*out)))


def _levels(leaves: DataFrame, high: int, first: int, name: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Nodes below the tops (tree, level, pos, seg, leaf) and the tops (tree, level, digest, leaf) of trees whose leaves are on level `first`."""
    kept, level, nodes, tops = [], leaves, None, None
    for base in range(0, max(high, 1), SPAN):
        built = stored(_span(level, first + base), name)
        kept.append(built)
        more = (F.col("level") == first + base + SPAN) & (F.col("total") > 1 << SPAN)
        own = built.where(F.col("seg").isNotNull()).select("tree", "level", "pos", "seg", "leaf")
        done = built.where(F.col("digest").isNotNull() & ~more).select("tree", "level", "digest", "leaf")
        nodes, tops = (own, done) if nodes is None else (nodes.unionByName(own), tops.unionByName(done))
        up = built.where(F.col("digest").isNotNull() & more)
        level = up.select("tree", "pos", "digest", F.ceil(F.col("total") / (1 << SPAN)).cast("long").alias("total"), "leaf")
    return nodes, tops, kept


def _jump(nodes: DataFrame, high: int) -> DataFrame:
    """Nodes with segments up to the root, `high` levels above the leaves: the leaves are among them."""
    up = 1
    while up < high:
        left = nodes.where(F.col("level") % (2 * up) == 0)
        right = nodes.where(F.col("level") % (2 * up) == up)
        right = right.select(F.struct("tree", "level", "pos").alias("_id"), F.col("seg").alias("_seg"), F.col("to").alias("_to"))
        if right.limit(FEW + 1).count() <= FEW:
            right = F.broadcast(right)
        both = left.join(right, F.col("to") == F.col("_id"), "left")
        seg = F.concat("seg", F.coalesce("_seg", F.lit(b"")))
        further = stored(both.select("tree", "level", "pos", seg.alias("seg"), F.coalesce("_to", "to").alias("to"), "leaf"), "proofs")
        discard(nodes)
        nodes, up = further, 2 * up
    return nodes


def manifest(docs: DataFrame, group: str = "lang", key: str = "doc_id", fields: Sequence[str] = FIELDS, carry: dict[str, Column] | None = None) -> DataFrame:
    """key, leaf, subroot, root (digests), proof and the carried columns of each row of `docs`.

    carry: more columns, computed from those of `docs`.
    """
    more = carry or {}
    leaf = [F.col(key).alias("key"), row_digest([F.col(c) for c in fields]).alias("digest"), *(c.alias(f"carry_{n}") for n, c in more.items())]
    rows, parts = in_order(docs.select(F.col(group).alias("group"), *leaf), ["group"], ["key", "digest"], "leaves")
    groups, group_parts = in_order(parts.select("group").distinct(), [], ["group"], "groups")
    trees = stored(placed(groups, group_parts, [], "tree").select(F.col("group").alias("_g"), "tree"), "trees")
    discard(groups)
    n_trees, largest = trees.count(), parts.agg(F.max("_total")).first()[0] or 0
    low, high = max(1, (largest - 1).bit_length()), (n_trees - 1).bit_length() if n_trees else 0

    parts = parts.join(trees, F.col("group").eqNullSafe(F.col("_g"))).drop("_g").withColumnRenamed("_total", "total")
    carried = F.struct("key", "digest", *(f"carry_{n}" for n in more)).alias("leaf")
    leaves = placed(rows, parts, ["group"]).select("tree", "pos", "digest", "total", carried)
    below, tops, kept = _levels(leaves, low, 0, "lower")
    # a lower tree's top goes on to level `low` by steps without an entry
    extended = tops.where(F.col("level") < low).withColumn("level", F.explode(F.sequence(F.col("level"), F.lit(low - 1))))
    extended = extended.select("tree", "level", F.lit(0).cast("long").alias("pos"), F.lit(b"").alias("seg"), F.when(F.col("level") == 0, F.col("leaf")).alias("leaf"))
    subroots = tops.groupBy("tree").agg(F.first("digest").alias("digest"))
    top_leaves = subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest", F.lit(n_trees).cast("long").alias("total"), F.lit(None).cast(leaves.schema["leaf"].dataType).alias("leaf"))
    above, root, kept_above = _levels(top_leaves, high, low, "upper")
    parent = F.when(F.col("level") + 1 == low, F.struct(F.lit(-1).cast("long").alias("tree"), F.lit(low).alias("level"), F.col("tree").alias("pos")))
    parent = parent.otherwise(F.struct("tree", (F.col("level") + 1).alias("level"), F.shiftright("pos", 1).alias("pos")))
    nodes = stored(below.unionByName(extended).unionByName(above).withColumn("to", parent), "nodes")
    subroots = stored(subroots.withColumnRenamed("tree", "_t"), "subroots")
    found = root.first()
    discard(rows, trees, *kept, *kept_above)
    proofs = _jump(nodes, low + high).where(F.col("level") == 0)
    if n_trees <= FEW:
        subroots = F.broadcast(subroots.withColumnRenamed("digest", "subroot"))
    else:
        subroots = subroots.withColumnRenamed("digest", "subroot")
    root_digest = F.lit(bytes(found["digest"]) if found else None).cast("binary").alias("root")
    return proofs.join(subroots, F.col("tree") == F.col("_t")).select(
        F.col("leaf.key").alias(key), F.col("leaf.digest").alias("leaf"), "subroot", root_digest,
        F.col("seg").alias("proof"), *(F.col(f"leaf.carry_{n}").alias(n) for n in more),
    )


def _entries(proof: Column) -> Column:
    n = F.floor(F.length(proof) / ENTRY).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substr(proof, i * ENTRY + 1, F.lit(ENTRY)))


def siblings(proof: Column) -> Column:
    """The digests of a proof, from leaf to root, as one hex text."""
    alone = F.lit(ALONE)
    return F.array_join(F.transform(F.filter(_entries(proof), lambda e: F.substr(e, F.lit(1), F.lit(1)) != alone), lambda e: text_of(F.substr(e, F.lit(2)))), "")


def fold(leaf: Column, proof: Column) -> Column:
    """The root digest that a leaf and its proof give."""

    def step(h: Column, e: Column) -> Column:
        side, other = F.substr(e, F.lit(1), F.lit(1)), F.substr(e, F.lit(2))
        return F.when(side == F.lit(LEFT), digest_of(other, h)).when(side == F.lit(RIGHT), digest_of(h, other)).otherwise(digest_of(h))

    return F.aggregate(_entries(proof), leaf, step)
