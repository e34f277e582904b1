"""key=value files: comments and lines without '=' are skipped, blanks around are cut, the last value of a key stands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import trimmed


def parse_config(lines: DataFrame, line: str = "line", order: str = "line_no") -> DataFrame:
    """(line_no, line) -> (key, value)."""
    text = trimmed(F.col(line))
    pairs = lines.select(order, text.alias("t")).filter("t NOT LIKE '#%' AND t LIKE '%=%'")
    each = pairs.select(order, trimmed(F.substring_index("t", "=", 1)).alias("key"), trimmed(F.expr("substring(t, instr(t, '=') + 1)")).alias("value"))
    return each.groupBy("key").agg(F.max_by("value", order).alias("value"))


def with_environment(config: DataFrame, environment: dict[str, str]) -> DataFrame:
    """Values of the environment come before those of the file."""
    if not environment:
        return config
    over = config.sparkSession.createDataFrame(sorted(environment.items()), "key string, env string")
    return config.join(over, "key", "full").select("key", F.coalesce("env", "value").alias("value"))
