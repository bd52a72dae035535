"""How the input tables are read."""

from pyspark.sql import functions as F

from crashlake.sources import tables as T


def test_logs_are_dealt_evenly_however_the_file_lies(spark, tmp_path, monkeypatch):
    """One row group, ascending keys: tasks follow the bytes, and rows that a filter keeps are spread over all of them."""
    rows = spark.range(60000).select(F.col("id").alias("event_id"), (F.col("id") * 7919 % 1000).alias("user_id"))
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    size = sum(f.stat().st_size for f in (tmp_path / "events.parquet").glob("*.parquet"))
    monkeypatch.setitem(T.LOG_BYTES, "events", size // 40)
    df = T.table(spark, str(tmp_path), "events")
    assert 40 <= df.rdd.getNumPartitions() <= 42
    for some, most in ((df, 60000), (df.where(F.col("event_id") < 8000), 8000)):
        counts = [r["count"] for r in some.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(counts) == most and max(counts) <= most / 40 * 1.2
    assert df.select("event_id").distinct().count() == 60000
