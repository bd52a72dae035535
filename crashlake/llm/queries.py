"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlake.llm import chat, oracle
from crashlake.llm.common import id_remainder, table

END_ID = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crashlake.llm.token_records import write_records

    records = write_records(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return records.read().select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crashlake.llm.mixing import mix

    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", taken, "copies")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crashlake.llm.langid import identify, train

    docs, rest = table(spark, sf_dir, "documents"), id_remainder("doc_id", 3)
    return identify(docs, train(docs.where(rest != 1)), rest == 1)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crashlake.llm.toxicity import THRESHOLD, labelled_rows, score, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = train(labelled_rows(docs, labels, id_remainder("doc_id", 4) != 2))
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), index, ["doc_id"])
    return scored.select(
        "doc_id",
        (id_remainder("doc_id", 4) == 2).alias("held_out"),
        F.col("_toxicity").alias("score"),
        (F.col("_toxicity") >= THRESHOLD).cast("int").alias("predicted"),
        F.col("_evidence").alias("evidence"),
    )


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crashlake.llm.quality import THRESHOLD, score, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, id_remainder("doc_id", 5) != 0)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, ["doc_id"])
    predicted = (F.col("_quality") >= THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), F.col("_quality").alias("score"), predicted)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crashlake.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crashlake.llm.decontaminate import decontaminate

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", (F.size("_items") > 0).alias("contaminated"), F.col("_coverage").alias("coverage"), F.col("_items").alias("item_ids")
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crashlake.llm.rules import judged

    return judged(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crashlake.llm.substrings import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crashlake.llm.chat import render

    return render(table(spark, sf_dir, "conversations"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from crashlake.llm.bpe import encode

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = encode(docs, path, public_tokenizers.PATTERN, ["doc_id"], decoded=True)
    return found.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crashlake.llm.trie import prefix_trie, with_shared_heads

    found = prefix_trie(*with_shared_heads(table(spark, sf_dir, "conversations")))
    numbers = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return found.select(*(F.col(c).cast("long").alias(c) for c in numbers), "ends_sha256")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crashlake.llm.manifest import FIELDS, fold, manifest, row_digest, siblings, text_of

    docs = table(spark, sf_dir, "documents")
    raised = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    altered = row_digest([raised if c == "n_chars" else F.col(c) for c in FIELDS])
    # null where a row isn't altered
    found = manifest(docs, carry={"altered": F.when(id_remainder("doc_id", 7) == 0, altered)})
    folded = fold(F.coalesce("altered", "leaf"), F.col("proof"))
    return found.withColumn("_folded", folded).select(
        "doc_id", text_of(F.col("leaf")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), text_of(F.col("root")).alias("root"),
        F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), text_of(F.col("_folded")).alias("folded_root"),
        (F.col("_folded") == F.col("root")).alias("verified"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality, op2_decontamination, op3_token_records, op4_suffix_dedup, op5_mixing,
        op6_toxicity, op7_quality_rules, op8_minhash, op9_chat, op10_language_id,
        op11_byte_bpe, op12_prefix_trie, op13_manifest,
    )
}
ORACLE_SQL: dict[str, str] = {"op9_chat": chat.ORACLE, "op12_prefix_trie": oracle.PREFIX_TRIE, "op13_manifest": oracle.MANIFEST}
