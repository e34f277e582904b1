"""State machines per stream: the rate ladder, the token bucket, the priority drain. Each is an ordered scan.

Nulls: an unknown rate or loss is 0, a request without size is of size 0, and one without time comes at the time of the
one before it; a drain without rate keeps the one it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .ordering import keyed_scan

#: Name and kbps of the levels, rising.
LADDER = (("low", 128), ("medium", 512), ("high", 2048))
LOSS_LIMIT, CONFIRMATIONS, HEADROOM = 0.05, 3, 1.3


def next_level(level: int, good: int, kbps: float, loss: float, ladder=LADDER, loss_limit: float = LOSS_LIMIT, confirmations: int = CONFIRMATIONS, headroom: float = HEADROOM) -> tuple[int, int]:
    """One evaluation. Bad conditions step down at once; enough good ones in a row step up if the rate carries the
    next level. An unknown rate (0) is good but carries nothing, and the row of good ones then goes on."""
    if loss >= loss_limit or 0 < kbps < ladder[level][1] * headroom:
        return max(level - 1, 0), 0
    good += 1
    if good >= confirmations and level + 1 < len(ladder) and kbps >= ladder[level + 1][1] * headroom:
        return level + 1, 0
    return level, good


def rate_ladder(samples: DataFrame, key: str, order: list[str], kbps: str, loss: str, ladder=LADDER, **limits) -> DataFrame:
    """Adds the level's name and kbps after each sample."""

    def step(state, row):
        state = next_level(*state, float(row[kbps] or 0), float(row[loss] or 0), ladder, **limits)
        return state, ladder[state[0]]

    return keyed_scan(samples, [key], order, [kbps, loss], lambda: (0, 0), step, "level string, level_kbps int")


class Bucket:
    """Tokens that refill with time; the first configuration fills it, a later one settles at the old rate first."""

    def __init__(self):
        self.rate = self.capacity = self.tokens = 0.0
        self.at: int | None = None

    def _refill(self, ms: int) -> None:
        self.tokens = min(self.capacity, self.tokens + max(0, ms - self.at) / 1000.0 * self.rate)
        self.at = ms

    def configure(self, rate: float, capacity: float, ms: int) -> None:
        if self.at is None:
            self.tokens, self.at = capacity, ms
        else:
            self._refill(ms)
        self.rate, self.capacity, self.tokens = rate, capacity, min(self.tokens, capacity)

    def take(self, amount: float, ms: int) -> bool:
        self._refill(ms)
        if self.tokens < amount:
            return False
        self.tokens -= amount
        return True


def token_bucket(requests: DataFrame, key: str, order: list[str], ms: str, size: str, rate: float, capacity: float) -> DataFrame:
    """Adds whether each request was accepted."""

    def step(bucket, row):
        now = row[ms] if row[ms] is not None else bucket.at or 0
        if bucket.at is None:
            bucket.configure(rate, capacity, now)
        return bucket, (bucket.take(float(row[size] or 0), now),)

    return keyed_scan(requests, [key], order, [ms, size], Bucket, step, "accepted boolean")


def priority_drain(queue: DataFrame, key: str, drain_ms: str, priority: str, order: list[str], size: str, kbps: str) -> DataFrame:
    """queue: packets with the time they are drained at and the kbps chosen then. At each drain the bucket gets that
    rate and half a second of burst; priority 0 passes free, others pay, and those that can't are dropped."""

    def step(state, row):
        bucket, last = state
        ms = row[drain_ms] if row[drain_ms] is not None else last or 0
        if ms != last:
            rate = bucket.rate if row[kbps] is None else row[kbps] * 1000.0 / 8.0
            bucket.configure(rate, rate * 0.5, ms)
        return (bucket, ms), (row[priority] == 0 or bucket.take(float(row[size] or 0), ms),)

    return keyed_scan(queue, [key], [drain_ms, priority, *order], [size, kbps], lambda: (Bucket(), None), step, "sent boolean")


def adaptive_drain(queue: DataFrame, reports: DataFrame, key: str, drain_ms: str, priority: str, order: list[str], size: str, kbps: str, loss: str) -> DataFrame:
    """The drain at the ladder's own rate. reports: (key, drain_ms, kbps, loss), what the network carried and lost by each
    drain; each moves the ladder, and the level it then stands on is the rate of that drain. A drain without report
    keeps the rate it has."""
    levels = rate_ladder(reports, key, [drain_ms], kbps, loss).select(key, drain_ms, "level_kbps")
    return priority_drain(queue.join(levels, [key, drain_ms], "left"), key, drain_ms, priority, order, size, "level_kbps")
