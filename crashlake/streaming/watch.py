"""Incremental level-A triage of crash files as fuzzers write them.

The batch plan uses the same operators; here the crash directory is a
Structured Streaming file source (`binaryFile`), each micro-batch hashes only
the new files, and the exact-dedup groups (first crash, count) are streaming
aggregation state, so a representative never has to be recomputed from all
files.  Progress and state live under the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlake import rules as R
from crashlake.session import ensure_checkpoint_dir
from crashlake.sources.ingest import BINARY_FILE, escape_glob, file_name, instance_from_path, is_instance, signal_from_name

def crash_stream(spark: SparkSession, root: str, max_files_per_trigger: int = 10000) -> DataFrame:
    """A1/A3/A4 as a stream: new files in `<root>/crashes/` if the root is an instance, else `<root>/<instance>/crashes/`.

    The glob is resolved again for every micro-batch, so instances that start
    later are found; whether the root is one is decided when the stream starts.
    """
    folders = "crashes" if is_instance(spark, root) else "*/crashes"
    df = (spark.readStream.format("binaryFile").schema(BINARY_FILE)
          .option("maxFilesPerTrigger", max_files_per_trigger)
          .load(f"{escape_glob(root.rstrip('/'))}/{folders}"))
    name = file_name(F.col("path"))
    return (df.where(~name.startswith(R.SKIP_NAME_PREFIX))
              .select(F.col("path"), name.alias("name"), instance_from_path(F.col("path")).alias("fuzzer_instance"),
                      signal_from_name(name).alias("signal"), F.col("length").alias("size"),
                      F.sha1(F.col("content")).alias("input_sha1")))


def exact_dedup_stream(crashes: DataFrame) -> DataFrame:
    """C1 over a stream: per content hash the first crash in (instance, name) order and the count."""
    first = F.min_by(F.struct("path", "name", "fuzzer_instance", "signal", "size"),
                     F.struct("fuzzer_instance", "name"))
    return (crashes.groupBy("input_sha1")
            .agg(first.alias("rep"), F.count(F.lit(1)).alias("duplicate_count"))
            .select("input_sha1", "rep.*", "duplicate_count"))


def start_exact_dedup(spark: SparkSession, root: str, out_dir: str, query_name: str = "crash_level_a",
                      available_now: bool = False):
    """Run the incremental level-A table as an append-only change log.

    Output mode `update` emits the full state (representative, count) of the
    groups a micro-batch touched; `foreachBatch` writes them to
    `<out_dir>/batch=<id>` (overwriting that one directory on a retry, so a
    replayed batch is idempotent).  `read_exact_dedup` folds the log to the
    current table.
    """
    ckpt = ensure_checkpoint_dir(spark).rstrip("/") + f"/streams/{query_name}"
    table = out_dir.rstrip("/")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    writer = (exact_dedup_stream(crash_stream(spark, root)).writeStream
              .outputMode("update").option("checkpointLocation", ckpt).queryName(query_name)
              .foreachBatch(write_batch))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def read_exact_dedup(spark: SparkSession, out_dir: str) -> DataFrame:
    """Current level-A table: per content hash the row of the latest batch that touched it."""
    log = spark.read.parquet(out_dir)
    cols = [c for c in log.columns if c not in ("input_sha1", "batch")]
    latest = F.max_by(F.struct(*cols), F.col("batch"))
    return log.groupBy("input_sha1").agg(latest.alias("_r")).select("input_sha1", "_r.*")
