"""Temporary views over the bound tables, for queries in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import bindings as b

VIEWS = {
    "event_log": b.event_log,
    "watermarks": b.watermarks,
    "group_commits": b.committed,
    "packets_sent": b.sent,
    "packets_arrived": b.arrived,
    "command_log": b.commands,
    "spans": b.spans,
}


def register_views(spark: SparkSession, sf_dir: str) -> list[str]:
    """spark.sql("SELECT partition, max(offset) FROM event_log GROUP BY partition") and the like."""
    for name, view in VIEWS.items():
        view(spark, sf_dir).createOrReplaceTempView(name)
    return sorted(VIEWS)
