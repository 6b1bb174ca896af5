"""Joins on hot keys are split by adaptive execution, as their grouped side is stored first."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from fiscus.llm.near_links import hub_links
from fiscus.shared import stored

LOW_LIMITS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "20",
    "spark.sql.files.maxPartitionBytes": "64k",
    "spark.sql.files.openCostInBytes": "1k",
}


@contextmanager
def settings(spark, values):
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_a_hot_bucket_is_dealt_out(spark):
    with settings(spark, LOW_LIMITS):
        rows = spark.range(0, 60_000, 1, 16)
        key = F.when(F.col("id") % 3 == 0, -1).otherwise((F.col("id") / 4).cast("long"))
        members = stored(rows.select(key.alias("key"), "id"), "members")
        links = hub_links(members)
        assert links.count() > 20_000
        found = links.collect()
        plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin(skew=true)" in plan
    hubs = {r.b for r in found if r.a % 3 == 0 and r.b % 3 == 0}
    assert len(hubs) == 1
