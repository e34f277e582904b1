"""Online statistics per stream: sliding-window rate and exponential averages. A null sample counts for nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import dense_ordinals, keyed_scan


def sliding_rate(samples: DataFrame, key: str, ms: str, size: str, window_ms: int) -> DataFrame:
    """Adds kbps over the samples of the last ``window_ms`` (both ends included); the time is that since the oldest of
    them, one millisecond at least.

    A key's samples are cut into stretches of window_ms, and each is also shown to the next stretch, which holds all
    that a window of its own samples can reach; so a key with many samples is spread over tasks.
    """
    stretch = F.floor(F.col(ms) / F.lit(max(1, window_ms)))
    shown = F.array(F.struct(stretch.alias("at"), F.lit(True).alias("own")), F.struct((stretch + 1).alias("at"), F.lit(False).alias("own")))
    each = samples.withColumn("_s", F.explode(shown))
    w = Window.partitionBy(key, "_s.at").orderBy(ms).rangeBetween(-window_ms, 0)
    span = F.greatest(F.col(ms) - F.min(ms).over(w), F.lit(1))
    return each.withColumn("kbps", F.sum(size).over(w) * 8.0 / 1000.0 / (span / 1000.0)).filter("_s.own").drop("_s")


def ema(samples: DataFrame, key: str, order: list[str], value: Column, alpha: float, name: str) -> DataFrame:
    """The last exponential average per key; the first sample counts whole. Keys without samples have none.

    As a sum of samples, each weighted by its distance from the last one, it merges like any other sum: no key's
    history is gathered in a row or a task.
    """
    known = samples.select(key, *order, value.cast("double").alias("_x")).filter("_x IS NOT NULL")
    placed = dense_ordinals(known, [key], order, "_at")
    total = known.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    keep, after = F.lit(1 - alpha), (F.col("_n") - 1 - F.col("_at")).cast("double")
    weight = F.when(F.col("_at") == 0, F.pow(keep, after)).otherwise(F.lit(alpha) * F.pow(keep, after))
    weighted = placed.join(total, F.col(key).eqNullSafe(F.col("_key"))).groupBy(key).agg(F.sum(weight * F.col("_x")).alias(name))
    return samples.select(key).distinct().join(weighted.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left").select(key, name)


def running_ema(samples: DataFrame, key: str, order: list[str], value: str, alpha: float, name: str) -> DataFrame:
    """The exponential average after every sample, in one pass with one number of state; after a null sample it is what it
    was before."""

    def step(state, row):
        x = row[value]
        if x is not None:
            state = float(x) if state is None else alpha * float(x) + (1 - alpha) * state
        return state, (state,)

    return keyed_scan(samples, [key], order, [value], lambda: None, step, f"{name} double")
