"""Repair of numbered packet streams: reorder, gaps, late packets, concealment, retransmission.

packets: (stream, sequence, arrival_ms, payload). A stream starts with its first-arrived packet: earlier
sequences are late, deadlines count from its arrival. Only the payload may be null; it then isn't taken over by later slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import encode_media
from ..functions.scalars import silence_of_payload
from .ordering import carried, with_ranges

#: Slots of a stream that one task plays.
CHUNK = 1 << 16


def starts(packets: DataFrame, interval_ms: int, delay_ms: int) -> DataFrame:
    """Per stream: its first and last sequence to play and the deadline of sequence 0 (base_ms)."""
    first = F.min(F.struct("arrival_ms", "sequence"))
    each = packets.groupBy("stream").agg(first.alias("_f"), F.max("sequence").alias("last"))
    return each.select("stream", F.col("_f.sequence").alias("base"), "last", (F.col("_f.arrival_ms") + delay_ms - F.col("_f.sequence") * interval_ms).alias("base_ms"))


def last_wins(packets: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Of packets with the same keys the one that came last."""
    return packets.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def playout(packets: DataFrame, interval_ms: int, delay_ms: int, drain: bool) -> DataFrame:
    """(stream, sequence, kind, payload) of every slot from the first to the last packet.

    drain: all packets are in before playing, so one plays if it came at all. Otherwise it plays if it came by
    its deadline. Other slots are concealed with the last payload that played.
    """
    began = starts(packets, interval_ms, delay_ms)
    on_time = packets.join(began, "stream").filter("sequence >= base")
    if not drain:
        on_time = on_time.filter(F.col("arrival_ms") <= F.col("base_ms") + F.col("sequence") * interval_ms)
    kept = on_time.groupBy("stream", "sequence").agg(F.max_by("payload", "arrival_ms").alias("_own"), F.lit(True).alias("_played"))
    chunk = F.floor(F.col("sequence") / CHUNK)
    # slots in two steps: an array holds at most CHUNK of them, however far the numbers jump
    chunks = began.select("stream", "base", "last", F.explode(F.sequence(F.floor(F.col("base") / CHUNK), F.floor(F.col("last") / CHUNK))).alias("_chunk"))
    slots = chunks.select("stream", "_chunk", F.explode(F.sequence(F.greatest("base", F.col("_chunk") * CHUNK), F.least("last", (F.col("_chunk") + 1) * CHUNK - 1))).alias("sequence"))
    # what a chunk takes over: the last payload of the chunks before it, a row a chunk
    ends = kept.filter("_own IS NOT NULL").groupBy("stream", chunk.alias("_chunk")).agg(F.max_by("_own", "sequence").alias("_last"))
    before = Window.partitionBy("stream").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    begins = chunks.select("stream", "_chunk").join(ends, ["stream", "_chunk"], "left").select("stream", "_chunk", F.last("_last", ignorenulls=True).over(before).alias("_over"))
    filled = Window.partitionBy("stream", "_chunk").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    played = slots.join(kept, ["stream", "sequence"], "left").withColumn("_own", F.last("_own", ignorenulls=True).over(filled))
    return played.join(begins, ["stream", "_chunk"]).select("stream", "sequence", F.when(F.col("_played"), "packet").otherwise("concealed").alias("kind"), F.coalesce("_own", "_over").alias("payload"))


def gaps(packets: DataFrame) -> DataFrame:
    """(stream, gap_start, gap_end, n_missing) between sequences that arrived; missing numbers are not expanded. Streams are
    worked on in ranges of the sequence."""
    each = with_ranges(packets.select("stream", "sequence").distinct(), ["sequence"])
    found = carried(each, ["stream"], ["sequence"], {"_next": ("following", F.col("sequence"))}).filter("_next > sequence + 1")
    return found.select("stream", (F.col("sequence") + 1).alias("gap_start"), (F.col("_next") - 1).alias("gap_end"), (F.col("_next") - F.col("sequence") - 1).alias("n_missing"))


def late(packets: DataFrame, interval_ms: int, delay_ms: int) -> DataFrame:
    """Packets before the stream's first sequence or after their deadline, and by how much."""
    deadline = F.col("base_ms") + F.col("sequence") * interval_ms
    return packets.join(starts(packets, interval_ms, delay_ms), "stream").filter((F.col("sequence") < F.col("base")) | (F.col("arrival_ms") > deadline)).select("stream", "sequence", (F.col("arrival_ms") - deadline).alias("late_ms"))


def effective_loss(played: DataFrame) -> DataFrame:
    return played.groupBy("stream").agg(F.count("*").alias("played"), F.count_if(F.col("kind") == "concealed").alias("concealed")).withColumn("loss", F.round(F.col("concealed") / F.col("played"), 6))


def recoverable(sent: DataFrame, arrived: DataFrame, capacity: int) -> DataFrame:
    """Missing sequences, and whether the sender's ring of its last ``capacity`` packets still has them."""
    newest = sent.groupBy("stream").agg(F.max("sequence").alias("_newest"))
    missing = sent.join(arrived.select("stream", "sequence"), ["stream", "sequence"], "left_anti")
    return missing.join(newest, "stream").select("stream", "sequence", (F.col("sequence") > F.col("_newest") - capacity).alias("recovered"))


def fill_forward(df: DataFrame, key: str, order: list[str], value: str, good: str, name: str) -> DataFrame:
    """Adds the last value of a good row up to and with each row; null before the first."""
    return carried(with_ranges(df, order), [key], order, {name: ("last", F.when(F.expr(good), F.col(value)))}).drop("_range")


def prepare_frames(payloads: DataFrame, interval_ms: int, threshold: int = 200) -> DataFrame:
    """(stream, sequence, payload) -> what a sender puts on the wire: time stamp, silence flag, and the packet."""
    flagged = payloads.withColumn("timestamp_ms", F.col("sequence") * interval_ms).withColumn("flags", silence_of_payload(F.col("payload"), threshold).cast("int"))
    return flagged.withColumn("packet", encode_media(F.col("sequence"), F.col("timestamp_ms"), F.col("flags"), F.col("payload")))
