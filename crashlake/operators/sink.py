"""Sink (H): the triage result as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def write_triage_tables(out_dir: str, issues: DataFrame, members: DataFrame,
                        rollups: dict[str, DataFrame] | None = None) -> None:
    """Write `issues` (partitioned by severity), `issue_members`, `cwe_long` and roll-ups.

    Arrays and structs are kept as Parquet nested types; the distribution is
    also written long-form so a consumer can filter by CWE without exploding.
    """
    base = out_dir.rstrip("/")
    flat = issues.drop("evidence") if "evidence" in issues.columns else issues
    flat.write.mode("overwrite").partitionBy("severity_level").parquet(f"{base}/issues")
    members.write.mode("overwrite").parquet(f"{base}/issue_members")
    (issues.select("ord", F.posexplode("cwe_distribution").alias("pos", "e"))
           .select("ord", "pos", F.col("e.cwe").alias("cwe"), F.col("e.w").alias("weight"))
           .write.mode("overwrite").parquet(f"{base}/cwe_long"))
    for name, df in (rollups or {}).items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")


CLASSIFIED_KEY = ["stack_hash", "top_cwe"]


def save_classified(classified: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """The classified crashes as a table, bucketed and sorted by the level-B key, for reports that are made again and again.

    Aggregations and joins on (stack hash, top CWE) read it without a shuffle,
    and any report reads the columns it needs.  A bucket is read by one task, so
    a stack that holds most crashes makes one long task; the triage itself
    starts from unbucketed files.
    """
    slim = classified.drop("evidence") if "evidence" in classified.columns else classified
    (slim.repartition(buckets, *CLASSIFIED_KEY).write.mode("overwrite").format("parquet").option("path", path)
         .bucketBy(buckets, *CLASSIFIED_KEY).sortBy(*CLASSIFIED_KEY).saveAsTable(table))
    return classified.sparkSession.table(table)
