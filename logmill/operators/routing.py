"""Where a record goes: round robin, key modulo, consistent-hash ring."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import portable_hash
from .ordering import dense_ordinals

VNODES = 128
#: The ring is looked up by the highest bits of the 60-bit hash.
CELL_BITS = 12


def round_robin(df: DataFrame, order: list[str], partitions: int) -> DataFrame:
    return dense_ordinals(df, [], order, "_ordinal").withColumn("partition", (F.col("_ordinal") % partitions).cast("int")).drop("_ordinal")


def key_modulo(key: Column, partitions: int) -> Column:
    return (portable_hash(key) % partitions).cast("int")


def ring_points(partitions: list[int], vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(point, partition) by rising point; of equal points the later one stands."""
    points: dict[int, int] = {}
    for p in partitions:
        for v in range(vnodes):
            points[int(hashlib.md5(f"{p}#vnode#{v}".encode()).hexdigest()[:15], 16)] = p
    return sorted(points.items())


def ring(spark: SparkSession, partitions: list[int], vnodes: int = VNODES) -> DataFrame:
    """The ring as (cell, low, high, partition): hashes h of a cell with low < h <= high belong to the partition.
    The cells turn the successor search into an equi-join; there are 2^CELL_BITS plus a row per point of them."""
    points = ring_points(partitions, vnodes)
    top, rows, low = 1 << 60, [], -1
    for high, p in [*points, (top - 1, points[0][1])]:
        for cell in range((low + 1) >> (60 - CELL_BITS), (high >> (60 - CELL_BITS)) + 1):
            rows.append((cell, low, high, p))
        low = high
    return spark.createDataFrame(rows, "cell long, low long, high long, partition int")


def on_ring(df: DataFrame, key: str, partitions: list[int], vnodes: int = VNODES, name: str = "partition") -> DataFrame:
    """Adds the partition of the first ring point at or after the key's hash, past the end the first point."""
    lookup = ring(df.sparkSession, partitions, vnodes).withColumnRenamed("partition", name)
    hashed = df.withColumn("_h", portable_hash(F.col(key))).withColumn("cell", F.shiftright("_h", 60 - CELL_BITS))
    # bounded: 2^CELL_BITS rows and one per point of the ring
    return hashed.join(F.broadcast(lookup), "cell").filter("_h > low AND _h <= high").drop("_h", "cell", "low", "high")


def balance(routed: DataFrame) -> DataFrame:
    """partition, n_keys and its share of all keys."""
    counted = routed.groupBy("partition").agg(F.count("*").alias("n_keys"))
    total = counted.agg(F.sum("n_keys").alias("_total"))
    return counted.crossJoin(F.broadcast(total)).select("partition", "n_keys", F.round(F.col("n_keys") / F.col("_total"), 6).alias("share"))


def moved(keys: DataFrame, before: str, after: str) -> DataFrame:
    """n_keys, n_moved and the moved fraction of two assignments of the same keys."""
    return keys.agg(F.count("*").alias("n_keys"), F.count_if(F.col(before) != F.col(after)).alias("n_moved")).withColumn("fraction", F.round(F.col("n_moved") / F.col("n_keys"), 6))
