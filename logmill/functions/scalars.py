"""Scalar functions over columns: hashing, time, formats, casts, PCM levels. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def portable_hash(key: Column) -> Column:
    """A 60-bit hash of a string that any engine with md5 can repeat."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long")


def millis(ts: str) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, whatever the session's time zone."""
    return F.expr(f"cast(floor(cast(cast({ts} - timestamp_ntz'1970-01-01 00:00:00' AS interval second) AS decimal(20, 6)) * 1000) AS bigint)")


def segment_name(base: Column) -> Column:
    return F.format_string("%020d.seg", base)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def config_int(text: Column, default: int) -> Column:
    """The leading integer of a text; the default if it has none or is out of 32 bits."""
    return F.coalesce(F.regexp_extract(text, r"^(-?\d+)", 1).try_cast("int"), F.lit(default))


def config_bool(text: Column, default: bool) -> Column:
    low = F.lower(text)
    return F.when(low.isin("1", "true", "yes", "on"), True).when(low.isin("0", "false", "no", "off"), False).otherwise(F.lit(default))


def config_double(text: Column, default: float) -> Column:
    number = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(number.try_cast("double"), F.lit(default))


def is_silent(samples: Column, threshold: int = 200) -> Column:
    """Mean absolute level, rounded down, below the threshold; no samples are silence."""
    total = F.aggregate(samples, F.lit(0).cast("long"), lambda a, x: a + F.abs(x.cast("long")))
    return F.when(F.size(samples) > 0, F.floor(total / F.size(samples)) < threshold).otherwise(True)


#: Log levels, the least severe first.
LEVELS = ("trace", "debug", "info", "warn", "error", "fatal")


def level_at_least(level: Column, least: str) -> Column:
    """Whether a log level is as severe as ``least``; unknown levels are not."""
    return level.isin(*LEVELS[LEVELS.index(least) :])


def silence_of_payload(payload: Column, threshold: int = 200) -> Column:
    """Silence of 16-bit little-endian samples in a payload; a last odd byte doesn't count, and under one sample the
    flag is not set."""
    digits = F.hex(payload)
    n = F.floor(F.octet_length(payload) / 2).cast("int")

    def sample(i: Column) -> Column:
        word = F.conv(F.concat(F.substr(digits, i * 4 + 3, F.lit(2)), F.substr(digits, i * 4 + 1, F.lit(2))), 16, 10).cast("int")
        return F.abs(F.when(word >= 32768, word - 65536).otherwise(word)).cast("long")

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda a, i: a + sample(i))
    return F.when(n >= 1, F.floor(total / n) < threshold).otherwise(False)
