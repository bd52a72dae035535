"""Input tables: parquet files of one data directory, registered as temp views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


#: Bytes of files behind one task, for tables whose short rows stand for replay logs that every rule reads.
LOG_BYTES = {"events": 1 << 18}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return deal(df, LOG_BYTES[name]) if name in LOG_BYTES else spread(df)


def deal(df: DataFrame, task_bytes: int) -> DataFrame:
    """Deal the rows of a scan evenly over tasks, one for each `task_bytes` of its files and at least one per core.

    Splits follow the files: their size grows with the input up to 128 MB, a file of few
    row groups fills few of them, and rows whose keys meet another table's lie side by
    side.  Filters on the rows alone run before they are dealt.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // task_bytes)))


def spread(df: DataFrame) -> DataFrame:
    """Give a scan at least one partition per core.

    A small file read as one split would run every per-row regex of the
    triage in a single task.  Large inputs already have more splits than
    cores and are returned unchanged (no extra shuffle at scale).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def register_tables(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """(Re)point the temp views `documents`, `events`, ... at `sf_dir`.

    Views are resolved when a DataFrame is analysed, so frames built earlier
    keep reading the directory they were built against.
    """
    from crashlake.functions.cache import context_key

    names = list(names or ["documents", "events", "supplier", "part", "lineitem"])
    key = (id(spark), context_key(spark.sparkContext), sf_dir, tuple(names))
    if _REGISTERED.get("current") == key and spark.catalog.tableExists(names[0]):
        return
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    _REGISTERED["current"] = key


_REGISTERED: dict = {}
