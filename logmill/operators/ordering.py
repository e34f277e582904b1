"""Ordinals and ordered scans that stay distributed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.storage import partitions_for


#: Rows of the sample for each range, and bytes of the input for each, where that asks for more than the shuffle partitions.
SAMPLE, RANGE_BYTES = 20, 128 << 20


def with_ranges(df: DataFrame, order: list[str], name: str = "_range") -> DataFrame:
    """Adds the number of a row's range in the given order, all order columns counted: about as many rows in each.

    The bounds come from the rows with the smallest hashes, a bounded sample that is the same whenever it is drawn, and
    are constants of the plan, so a lost task cuts the same way again. A row finds its range in a binary search.
    """
    n = partitions_for(df, RANGE_BYTES)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    picked = df.select(*order).orderBy(F.xxhash64(*order), *order).limit(SAMPLE * n).orderBy(*order)
    found = picked.select(*(F.col(c).cast("string") for c in order)).collect()
    cuts = list(dict.fromkeys(tuple(found[i * len(found) // n]) for i in range(1, n))) if found else []
    if not cuts:
        return df.withColumn(name, F.lit(0))
    text = lambda v: "NULL" if v is None else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    bounds = F.expr("array(" + ", ".join("named_struct(" + ", ".join(f"'{i}', try_cast({text(v)} AS {kinds[c]})" for i, (c, v) in enumerate(zip(order, cut, strict=True))) + ")" for cut in cuts) + ")")
    at = F.struct(*(F.col(c).alias(str(i)) for i, c in enumerate(order)))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        pair = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
        return F.when(s["low"] >= s["high"], s).when(F.get(bounds, middle) <= at, pair(middle + 1, s["high"])).otherwise(pair(s["low"], middle))

    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
    return df.withColumn(name, F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high")), halve, lambda s: s["low"]))


def carried(cut: DataFrame, keys: list[str], order: list[str], wanted: dict[str, tuple[str, Column]], name: str = "_range") -> DataFrame:
    """Adds columns that depend on the other rows of a key in a (unique) order, without one task per key. wanted: name ->
    ("before", x): the sum of x in all rows before; ("last", x): the last x up to and with the row that isn't null;
    ("previous" or "following", x): x of the row before or after, null for the first or last.

    Each range of a key is worked on alone, and what comes over from its other ranges is added: a row per key and range.
    """
    own = Window.partitionBy(*keys, name).orderBy(*order)
    parts = Window.partitionBy(*keys).orderBy(name)
    earlier, later = parts.rowsBetween(Window.unboundedPreceding, -1), parts.rowsBetween(1, Window.unboundedFollowing)
    place = F.struct(*order)
    local, ends, over, final = {}, [], {}, {}
    for c, (kind, x) in wanted.items():
        boxed = F.struct(x.alias("x"))
        if kind == "before":
            local[c] = F.coalesce(F.sum(x).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            ends.append(F.sum(x).alias(f"_e_{c}"))
            over[c] = F.coalesce(F.sum(f"_e_{c}").over(earlier), F.lit(0))
            final[c] = F.col(f"_l_{c}") + F.col(f"_c_{c}")
        elif kind == "last":
            local[c] = F.last(x, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
            ends.append(F.max_by(x, F.when(x.isNotNull(), place)).alias(f"_e_{c}"))
            over[c] = F.last(f"_e_{c}", ignorenulls=True).over(earlier)
            final[c] = F.coalesce(f"_l_{c}", f"_c_{c}")
        elif kind in ("previous", "following"):
            back = kind == "previous"
            local[c] = (F.lag if back else F.lead)(boxed).over(own)
            ends.append((F.max_by if back else F.min_by)(boxed, place).alias(f"_e_{c}"))
            over[c] = F.last(f"_e_{c}").over(earlier) if back else F.first(f"_e_{c}").over(later)
            final[c] = F.coalesce(f"_l_{c}", f"_c_{c}")["x"]
        else:
            raise ValueError(kind)
    table = cut.groupBy(*keys, name).agg(*ends).select(*(F.col(k).alias(f"_k_{k}") for k in (*keys, name)), *(o.alias(f"_c_{c}") for c, o in over.items()))
    within = cut.withColumns({f"_l_{c}": x for c, x in local.items()})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, name)]
    return within.join(table, on).select(*cut.columns, *(x.alias(c) for c, x in final.items()))


def dense_ordinals(df: DataFrame, keys: list[str], order: list[str], name: str, weight: Column | None = None) -> DataFrame:
    """Adds 0, 1, 2, ... in the given (unique) order within each key (with ``weight``: the sum of it in the rows before),
    spread over tasks whatever a key's share of the rows. Rows whose key is null are a key of their own."""
    one = F.lit(1) if weight is None else weight
    return carried(with_ranges(df, order), keys, order, {name: ("before", one.cast("long"))}).drop("_range")


def keyed_scan(df: DataFrame, keys: list[str], order: list[str], fields: list[str], start: Callable, step: Callable, out: str) -> DataFrame:
    """One result per row: ``step(state, row) -> (state, results)`` over each key's rows in order.

    The rows of a key stream through in Arrow batches with one state held, so a history of any length runs in
    bounded memory. ``out``: the DDL of the result columns, which follow keys, order and fields.
    """
    kept = [*dict.fromkeys([*keys, *order, *fields])]
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", " + out
    results = [c.split()[0] for c in out.split(", ")]
    n_keys = len(keys)
    types = [f.type for f in to_arrow_schema(StructType.fromDDL(out))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            made: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n_keys] != now:
                    now, state = row[:n_keys], start()
                state, result = step(state, dict(zip(kept, row, strict=True)))
                made.append(result)
            extra = [pa.array([m[i] for m in made], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*kept, *results])

    return df.select(*kept).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
