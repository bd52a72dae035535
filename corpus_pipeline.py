"""Corpus pipeline: toxicity, near-duplicates, benchmark passages, mixing, token records.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's `docs`.  All but the last
return the columns of `docs`.  Every stage works on what its predecessor kept,
decides over all of it, and lets its decision take effect.  Columns other than
`DOCUMENT` are renamed by place while a stage works, so they pass whatever their
names; an empty table passes every stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crashlake.llm import decontaminate, minhash, mixing, token_records, toxicity
from crashlake.llm.common import stored, table
from crashlake.llm.queries import END_ID, tokenizer_path

ORACLE_SQL = None  # classifiers, random rounding and tokenizers can't be expressed in SQL
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def own_columns(stage: Stage) -> Stage:
    """The stage on `docs` with its extra columns renamed, and its rows with their names again."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner = docs.toDF(*(c if c in DOCUMENT else f"extra_{i}" for i, c in enumerate(docs.columns)))
        return stage(spark, inner, sf_dir).toDF(*docs.columns)

    return run


@own_columns
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; learned from a bounded sample of the labelled documents of `docs`.

    Null and empty texts get the share of toxic examples without a known word; without labels all are kept.
    """
    labels = table(spark, sf_dir, "labels")
    index = toxicity.train(toxicity.labelled_rows(docs, labels, F.lit(True)))
    scored = toxicity.score(docs, index)
    return scored.where(F.col("_toxicity") < toxicity.THRESHOLD).select(docs.columns)


@own_columns
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, one with the smallest id; rows without an id are kept.

    Rows are compared by their texts, also those that share an id, so quite different ones stay;
    of rows without words, one is kept for each id.
    """
    own_id = F.col("doc_id").cast("long")
    rows = docs.withColumn("_row", F.when(own_id.isNotNull(), F.xxhash64(own_id, "text")))  # rows of equal id and text are one
    found = minhash.near_duplicates(rows.where(own_id.isNotNull()).select(F.col("_row").alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias("_row"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("_group"))
    ids = rows.where(own_id.isNotNull()).select("_row", own_id.alias("_id"), F.xxhash64("text").alias("_text")).distinct()
    found = found.distinct().join(ids, "_row")
    # a group's first row by id; rows of equal id by text, so reruns agree
    empty = F.when(F.col("_group").isNull(), F.col("_id"))
    first = found.groupBy("_group", empty.alias("_empty")).agg(F.min(F.struct("_id", "_text", "_row")).alias("_first"))
    kept = first.select(F.col("_first._row").alias("_row"))
    # of equal rows one stays
    once = F.row_number().over(Window.partitionBy("_row", "doc_id").orderBy(*(F.xxhash64(c) for c in docs.columns)))
    one = rows.join(kept, "_row", "left_semi").withColumn("_nth", once).where(F.col("_nth") == 1)
    return rows.where(own_id.isNull()).select(docs.columns).unionByName(one.select(docs.columns))


@own_columns
def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item is tiled in; null and empty texts, and all if there is no item, are kept."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("_items") == 0).select(docs.columns)


@own_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents of no words (null, empty) are kept once.

    A null source is a source; rows of one id are told apart by a row number.
    """
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    copies = mixing.mix(rows, key="_row").select("_row", F.col("size").alias("_size"), "copies")
    joined = rows.join(copies, "_row")
    times = F.when(F.col("_size") > 0, F.col("copies")).otherwise(F.lit(1)).cast("int")
    return joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times))).select(docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The records of all documents, read back from the files; null texts are the end id alone, null ids come first."""
    records = token_records.write_records(docs, tokenizer_path(), END_ID)
    return records.read().select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("token_records", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
