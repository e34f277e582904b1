"""Counters, gauges, histograms, their text form, percentiles, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import scratch_folder
from .ordering import dense_ordinals

#: Bounds of the publish histogram, in microseconds.
PUBLISH_BUCKETS = (10, 25, 50, 100, 250, 500, 1000, 5000, 10000)


def counters(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("value"))


def gauge_last(df: DataFrame, by: str, value: str, order: list[str]) -> DataFrame:
    return df.groupBy(by).agg(F.max_by(value, F.struct(*order)).alias("value"))


def histogram(df: DataFrame, by: str, value: str, bounds: tuple[float, ...]) -> DataFrame:
    """(by, bound, cumulative), one row a bound and one for infinity (null bound), and count and sum. A value equal to a
    bound counts in the next bucket. One pass: a sum a bound, no row per observation."""
    sums = [F.count_if(F.col(value) < b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(by).agg(*sums, F.count(value).alias("count"), F.sum(value).alias("sum"))
    rows = F.array(*(F.struct(F.lit(float(b)).alias("bound"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)), F.struct(F.lit(None).cast("double").alias("bound"), F.col("count").alias("cumulative")))
    return wide.select(by, F.explode(rows).alias("r"), "count", "sum").select(by, "r.bound", "r.cumulative", "count", "sum")


def sampled(df: DataFrame, ordinal: str, every: int = 16) -> DataFrame:
    """Every 16th record, the first included."""
    return df.filter(F.col(ordinal) % every == 0)


def prometheus(counted: DataFrame, gauges: DataFrame, histograms: DataFrame) -> DataFrame:
    """One row ``text``: counters, gauges, then histograms, each by name. Metrics are few by nature; they are joined
    after aggregation. counted, gauges: (name, value); histograms: (name, bound, cumulative, count, sum)."""
    simple = lambda df, kind, rank: df.select(F.lit(rank).alias("k"), F.col("name"), F.lit(0).alias("i"), F.concat(F.lit("# TYPE "), "name", F.lit(f" {kind}\n"), "name", F.lit(" "), F.col("value").cast("string"), F.lit("\n")).alias("t"))
    number = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("bound", F.lit(float("inf"))).alias("b"), F.coalesce(number("bound"), F.lit("+Inf")).alias("le"), "cumulative"))), lambda r: F.concat(F.col("name"), F.lit('_bucket{le="'), r["le"], F.lit('"} '), r["cumulative"].cast("string"), F.lit("\n")))
    full = histograms.groupBy("name", "count", "sum").agg(lines.alias("lines"))
    text = F.concat(F.lit("# TYPE "), "name", F.lit(" histogram\n"), F.array_join("lines", ""), F.col("name"), F.lit("_sum "), number("sum"), F.lit("\n"), F.col("name"), F.lit("_count "), F.col("count").cast("string"), F.lit("\n"))
    parts = simple(counted, "counter", 0).unionAll(simple(gauges, "gauge", 1)).unionAll(full.select(F.lit(2).alias("k"), "name", F.lit(0).alias("i"), text.alias("t")))
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name", "i", "t"))), lambda r: r["t"]), "").alias("text"))


def numeric_stats(stats: DataFrame, keys: list[str]) -> DataFrame:
    """(node, key, value text) -> (node, key, value) of the known keys whose value is a whole number."""
    return stats.filter(F.col("key").isin(keys)).withColumn("value", F.col("value").try_cast("long")).filter("value IS NOT NULL")


def percentiles(df: DataFrame, by: str, value: str, percents: tuple[int, ...]) -> DataFrame:
    """Exact: the value at place n * p / 100, rounded down, in sorted order. Equal values are counted first, so a value of
    any share is one row; the places of the rest come from a distributed sort."""
    each = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_c"))
    placed = dense_ordinals(each, [by], [value], "_place", F.col("_c"))
    total = each.groupBy(F.col(by).alias("_by")).agg(F.sum("_c").alias("_n"))
    at = lambda p: F.least(F.floor(F.col("_n") * p / 100), F.col("_n") - 1)
    here = F.filter(F.array(*map(F.lit, percents)), lambda p: (at(p) >= F.col("_place")) & (at(p) < F.col("_place") + F.col("_c")))
    return placed.join(total, F.col(by).eqNullSafe(F.col("_by"))).select(by, F.explode(here).alias("percent"), value)


def throughput(df: DataFrame, by: str, ms: str) -> DataFrame:
    span = F.max(ms) - F.min(ms)
    return df.groupBy(by).agg(F.count("*").alias("n"), span.alias("span_ms"), F.round(F.count("*") / (F.when(span > 0, span) / 1000.0), 6).alias("per_second"))


def span_tree(spans: DataFrame) -> DataFrame:
    """spans: (trace_id, span_id, parent_span_id (0: a root), start_ms, end_ms). Adds depth and duration to the spans that
    a root reaches.

    Pointers double: in each round a span's pointer jumps to where the span it points to points, so spans of depth d are
    done after log2(d) equi-joins. Rounds are written to the shared folder; one that finishes no span is the last, as what
    is left hangs on a missing parent or on a cycle. Of a span that comes with several parents the smallest counts.
    """
    spark = spans.sparkSession
    now = spans.groupBy("trace_id", "span_id").agg(F.min("parent_span_id").alias("up")).withColumn("depth", F.when(F.col("up") == 0, 0).otherwise(1))
    done = 0
    while True:
        folder = scratch_folder(spark, "spans")
        now.write.parquet(folder)
        now = spark.read.schema(now.schema).parquet(folder)
        state = now.agg(F.count_if(F.col("up") == 0).alias("done"), F.count("*").alias("n")).first()
        if state["done"] in (done, state["n"]):
            break
        done = state["done"]
        above = now.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        jumped = now.filter("up <> 0").join(above, ["trace_id", "up"], "left")
        now = now.filter("up = 0").unionByName(jumped.filter("_up IS NOT NULL").select("trace_id", "span_id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth")))
    reached = now.filter("up = 0").select("trace_id", "span_id", "depth")
    return spans.join(reached, ["trace_id", "span_id"]).select(*spans.columns, "depth", F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)).alias("duration_ms"))


def children(spans: DataFrame) -> DataFrame:
    """Per span its number of children and their time."""
    kids = spans.filter("parent_span_id <> 0").groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(F.count("*").alias("n_children"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("child_ms"))
    return spans.join(kids, ["trace_id", "span_id"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_children", "child_ms")})
