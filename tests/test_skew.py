"""A stack key holding 90 % of all crashes dedups to one issue with the full count."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from crashlake.plans.skew import skewed_level_b, skewed_logs


def test_hot_stack_key(spark):
    logs = skewed_logs(spark, SF_SMALL)
    n = logs.count()
    n_hot = logs.where(F.col("ord") % 10 != 0).count()
    b = skewed_level_b(spark, SF_SMALL)
    hot = b.where(F.col("crash_location") == "/src/hot.c:42").collect()
    assert len(hot) == 1
    assert hot[0].duplicate_count == n_hot and hot[0].merged_issues == n_hot
    assert hot[0].ord == 1                       # first crash in order represents the group
    assert b.agg(F.sum("duplicate_count")).first()[0] == n
