"""The streaming forms of windows, sessions, dedup, playout and averages.

Tables of the batch operators have timestamps without time zone; streams need one for watermarks, so callers cast.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType


def tumbling_counts(events: DataFrame, ts: str, by: str, width: str, late: str) -> DataFrame:
    w = F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def dedup(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """The first of the rows with the same keys within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


class Ema(StatefulProcessor):
    """Input (key, ms, x): the exponential average after each sample of a key; batches are taken in order of ms."""

    OUT = StructType([StructField("user_id", LongType()), StructField("ms", LongType()), StructField("ema", DoubleType())])

    def __init__(self, alpha: float):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ema", StructType([StructField("ema", DoubleType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get()[0] if self.state.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values("ms").itertuples():
            if not pd.isna(r.x):  # a null sample leaves the average as it is
                now = float(r.x) if now is None else self.alpha * float(r.x) + (1 - self.alpha) * now
            out.append((key[0], r.ms, now))
        if now is not None:
            self.state.update((now,))
        yield pd.DataFrame(out, columns=["user_id", "ms", "ema"])

    def close(self) -> None:
        pass


class SlidingRate(StatefulProcessor):
    """Input (user_id, ms, bytes): kbps over the samples of the last window_ms after each sample, as the batch operator has it.
    What is held of a key is its last window; batches are taken in order of ms, and samples of one ms together."""

    OUT = StructType([StructField("user_id", LongType()), StructField("ms", LongType()), StructField("kbps", DoubleType())])

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", StructType([StructField("ms", LongType()), StructField("bytes", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = deque(map(tuple, self.recent.get())), []
        total = sum(b for _, b in held)
        for ms, same in pd.concat(list(rows)).sort_values("ms").groupby("ms", sort=True)["bytes"]:
            ms, sizes = int(ms), [0 if pd.isna(b) else int(b) for b in same]
            held.extend((ms, b) for b in sizes)
            total += sum(sizes)
            while held[0][0] < ms - self.window_ms:
                total -= held.popleft()[1]
            rate = total * 8.0 / 1000.0 / (max(ms - held[0][0], 1) / 1000.0)
            out += [(key[0], ms, rate)] * len(sizes)
        self.recent.put(list(held))
        yield pd.DataFrame(out, columns=["user_id", "ms", "kbps"])

    def close(self) -> None:
        pass


class Sessions(StatefulProcessor):
    """Input (user_id, ms): sessions parted by gaps of gap_ms or more; a session leaves when the watermark passes its end by
    the gap. Until then events in any order lengthen it at both ends or join it with another.

    Each access to the state goes to the JVM and back, so the open sessions of a key are one value, in order, and its
    only timer is that of the first to end; all that have ended leave with it.
    """

    OUT = StructType([StructField("user_id", LongType()), StructField("session_start", LongType()), StructField("session_end", LongType()), StructField("n", LongType())])

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("sessions", StructType([StructField(c, ArrayType(LongType())) for c in ("first", "last", "n")]))

    def _merged(self, first: np.ndarray, last: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(first, kind="stable")
        first, last, n = first[order], last[order], n[order]
        apart = first[1:] - np.maximum.accumulate(last)[:-1] >= self.gap_ms
        starts = np.flatnonzero(np.concatenate(([True], apart)))
        return first[starts], np.maximum.reduceat(last, starts), np.add.reduceat(n, starts)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.open.get()
        spans = tuple(np.array(c, np.int64) for c in held or ([], [], []))
        due = int(spans[1][0]) + self.gap_ms if held else None
        for frame in rows:
            ms = frame["ms"].astype("int64").to_numpy()
            spans = self._merged(*(np.concatenate(c) for c in zip(spans, (ms, ms, np.ones(len(ms), np.int64)), strict=True)))
        self._keep(spans, due)
        yield from ()

    def _keep(self, spans, due: int | None) -> None:
        """Holds sessions, and sets the timer, which is at ``due``, to the first end."""
        self.open.update(tuple(c.tolist() for c in spans))
        first = int(spans[1][0]) + self.gap_ms
        if first != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, last, n = (np.array(c, np.int64) for c in self.open.get())
        over = int(np.searchsorted(last, timerValues.getCurrentWatermarkInMs() - self.gap_ms, side="right"))
        if over < len(last):
            self._keep((first[over:], last[over:], n[over:]), None)  # the timer that fired is gone
        else:
            self.open.clear()
        yield pd.DataFrame({"user_id": key[0], "session_start": first[:over], "session_end": last[:over], "n": n[:over]})

    def close(self) -> None:
        pass


class Waiting:
    """The packets that wait for their slots, over a map state of blocks: those of all streams of a key whose deadlines lie
    in the same BLOCK slots of time. A block is read when it is first asked for and, if it changed, written once, by
    save(). stored: the numbers of the blocks that the state has."""

    BLOCK = 64
    KEY = StructType([StructField("block", LongType())])
    VALUE = StructType([StructField(c, ArrayType(LongType())) for c in ("streams", "sequences")] + [StructField("payloads", ArrayType(StringType()))])

    def __init__(self, state, stored: list[int], interval_ms: int):
        self.state, self.stored, self.width_ms = state, set(stored), self.BLOCK * interval_ms
        self.blocks: dict[int, dict[tuple[int | None, int], str | None]] = {}
        self.changed: set[int] = set()

    def _block(self, n: int) -> dict[tuple[int | None, int], str | None]:
        if n not in self.blocks:
            streams, sequences, payloads = self.state.getValue((n,)) if n in self.stored else ((), (), ())
            self.blocks[n] = dict(zip(zip(streams, sequences, strict=True), payloads, strict=True))
        return self.blocks[n]

    def put(self, stream: int | None, sequence: int, deadline_ms: int, payload: str | None) -> None:
        n = deadline_ms // self.width_ms
        self._block(n)[stream, sequence] = payload
        self.changed.add(n)

    def take(self, stream: int | None, sequence: int, deadline_ms: int) -> tuple[str | None] | None:
        n = deadline_ms // self.width_ms
        if n not in self.stored or (stream, sequence) not in self._block(n):
            return None
        self.changed.add(n)
        return (self.blocks[n].pop((stream, sequence)),)

    def save(self) -> list[int]:
        """Writes what changed; returns the numbers of the blocks that the state has now."""
        for n in self.changed:
            if self.blocks[n]:
                self.state.updateValue((n,), (*(list(c) for c in zip(*self.blocks[n], strict=True)), list(self.blocks[n].values())))
                self.stored.add(n)
            elif n in self.stored:
                self.state.removeKey((n,))
                self.stored.remove(n)
        return sorted(self.stored)


class Playout(StatefulProcessor):
    """Input (stream, sequence, arrival_ms, payload): slots in order, packet or concealed with the last payload. A slot's
    packet must have come by its deadline; a slot is settled by the first later packet or by a timer at the deadline
    of the newest packet.

    A key is a stream, or holds all packets of many (see keyed()): keys cost more than packets, as each access to the state
    goes to the JVM and back. The places of a key's streams are one value, read and written once a batch, the packets that
    wait are in blocks, and its only timer is that of the stream to end first; all that have ended are settled with it."""

    OUT = StructType([StructField("stream", LongType()), StructField("sequence", LongType()), StructField("kind", StringType()), StructField("payload", StringType())])
    PLACES = StructType(
        [StructField(c, ArrayType(LongType())) for c in ("stream", "base_ms", "next")]
        + [StructField("last", ArrayType(StringType())), StructField("newest", ArrayType(LongType())), StructField("blocks", ArrayType(LongType())), StructField("due", LongType())]
    )

    def __init__(self, interval_ms: int, delay_ms: int):
        self.interval_ms, self.delay_ms = interval_ms, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.places = handle.getValueState("places", self.PLACES)
        self.waiting = handle.getMapState("waiting", Waiting.KEY, Waiting.VALUE)

    def _read(self) -> tuple[dict[int | None, list], Waiting, int | None]:
        """The places of the key's streams, (base_ms, next, last, newest) each, their packets and when the timer is due."""
        *columns, blocks, due = self.places.get() or ([],) * 6 + (None,)
        return {s: place for s, *place in zip(*columns, strict=True)}, Waiting(self.waiting, blocks, self.interval_ms), due

    def _keep(self, places: dict[int | None, list], waiting: Waiting, due: int | None) -> None:
        """Writes all back, and sets the timer, which is at ``due``, to the first end of a stream that isn't settled."""
        first = min((base_ms + newest * self.interval_ms + 1 for base_ms, at, _, newest in places.values() if at <= newest), default=None)
        if first != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if first is not None:
                self.handle.registerTimer(first)
        columns = zip(*((s, *place) for s, place in places.items()), strict=True)
        self.places.update((*(list(c) for c in columns), waiting.save(), first))

    def _play(self, stream: int | None, place: list, came: dict[int, str | None], waiting: Waiting, until_ms: int, out: list[tuple]) -> None:
        """Slots whose deadline is before ``until_ms``, up to the newest packet. came: packets of this batch that wait."""
        base_ms, at, last, newest = place
        stop = min(newest, (until_ms - base_ms - 1) // self.interval_ms)
        while at <= stop:
            held = waiting.take(stream, at, base_ms + at * self.interval_ms) if waiting.stored else None
            if at in came:
                held = (came.pop(at),)
            if held is not None:
                last = held[0]
            out.append((stream, at, "concealed" if held is None else "packet", last))
            at += 1
        place[1:3] = at, last

    def _told(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(dict(zip(self.OUT.names, zip(*out, strict=True), strict=True)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        places, waiting, due = self._read()
        packets, out = [], []
        for frame in rows:
            streams = frame["stream"].tolist() if "stream" in frame else [key[0]] * len(frame)
            packets += zip((None if pd.isna(s) else int(s) for s in streams), *(frame[c].tolist() for c in ("arrival_ms", "sequence", "payload")), strict=True)
        packets.sort(key=lambda p: p[1:3])
        each: dict[int | None, list] = {}
        for stream, *packet in packets:
            each.setdefault(stream, []).append(packet)
        for stream, mine in each.items():
            came: dict[int, str | None] = {}
            place = places.get(stream)
            if place is None:
                arrival_ms, sequence, _ = mine[0]
                place = places[stream] = [arrival_ms + self.delay_ms - sequence * self.interval_ms, sequence, None, sequence]
            for arrival_ms, sequence, payload in mine:
                self._play(stream, place, came, waiting, arrival_ms, out)
                if sequence >= place[1]:
                    # slots between are still open, or are settled as concealed once this one is the newest
                    place[3] = max(place[3], sequence)
                    if arrival_ms <= place[0] + sequence * self.interval_ms:
                        came[sequence] = payload
                    self._play(stream, place, came, waiting, arrival_ms, out)
            for sequence, payload in came.items():
                waiting.put(stream, sequence, place[0] + sequence * self.interval_ms, payload)
        self._keep(places, waiting, due)
        yield from self._told(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        places, waiting, _ = self._read()
        over, out = timerValues.getCurrentWatermarkInMs(), []
        for stream, place in places.items():
            if place[0] + place[3] * self.interval_ms < over:
                self._play(stream, place, {}, waiting, 1 << 62, out)
        self._keep(places, waiting, None)  # the timer that fired is gone
        yield from self._told(out)

    def close(self) -> None:
        pass


def keyed(stream: DataFrame, key: str, processor: StatefulProcessor, ts: str | None = None, late: str = "0 seconds", buckets: int | None = None) -> DataFrame:
    """A stateful processor per key; with ``ts`` its timers run on event time. With ``buckets`` that many keys, each with all
    rows of some of the values of ``key``, for processors that tell these apart."""
    if ts:
        stream = stream.withWatermark(ts, late)
    if buckets:
        stream, key = stream.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets))), "_bucket"
    return stream.groupBy(key).transformWithStateInPandas(processor, outputStructType=processor.OUT, outputMode="Append", timeMode="EventTime" if ts else "None")
