"""Unit arithmetic of the sample, frame and window grids, as Column expressions (exact integers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echolith.constants import DEFAULT_INTERVAL_MS, DEFAULT_WINDOW_MS, FRAME_SIZE, HOP_SIZE, MAX_SOURCE_RATE, TARGET_RATE, U32_MAX



def quotient(a: Column, b: int | Column) -> Column:
    """Integer division of non-negative longs, exact over the whole range."""
    return F.call_function("div", a.cast("long"), (b if isinstance(b, Column) else F.lit(b)).cast("long"))


def samples_for_ms(ms: Column) -> Column:
    return quotient(ms.cast("long") * TARGET_RATE, 1000)


def ms_for_samples(n: Column) -> Column:
    """Rounded half up; saturates at the largest unsigned 32-bit value."""
    return F.least(quotient(n.cast("long") * 1000 + TARGET_RATE // 2, TARGET_RATE), F.lit(U32_MAX))


def frame_count(n: Column) -> Column:
    return F.when(n < FRAME_SIZE, F.lit(0).cast("long")).otherwise(quotient(n - FRAME_SIZE, HOP_SIZE) + 1)


def resampled_length(frames: Column, rate: Column) -> Column:
    return F.floor(frames / (rate / F.lit(float(TARGET_RATE)))).cast("long")


def _error(code: str, message: Column | str) -> Column:
    return F.struct(F.lit(code).alias("code"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))


def rate_error(rate: Column) -> Column:
    """A (code, message) struct, or null for a usable source rate."""
    return F.when(rate == 0, _error("invalid", "sample rate must be greater than 0")).when(rate > MAX_SOURCE_RATE, _error("invalid", f"sample rate must be at most {MAX_SOURCE_RATE} Hz"))


def shape_error(rate: Column, channels: Column) -> Column:
    return F.coalesce(rate_error(rate), F.when(channels == 0, _error("invalid", "channel count must be greater than 0")))


def window_error(window_ms: Column, interval_ms: Column) -> Column:
    n = samples_for_ms(window_ms)
    short = F.format_string(f"Window too short: %d samples, need at least {FRAME_SIZE}", n)
    return F.when(n < FRAME_SIZE, _error("invalid", short)).when(samples_for_ms(interval_ms) == 0, _error("invalid", "Window interval must be greater than 0"))


def status_of(code: Column) -> Column:
    """The number of an error code; 0 for none."""
    return F.when(code.isNull(), 0).when(code == "decode", 1).when(code == "unsupported", 2).when(code == "invalid", 3).when(code == "io", 4).otherwise(5)


def windows(n_samples: Column, window_ms: Column | int = DEFAULT_WINDOW_MS, interval_ms: Column | int = DEFAULT_INTERVAL_MS) -> Column:
    """Array of (window_idx, start, timestamp_ms, duration_ms, first_frame, last_frame) of the complete windows of a signal.

    last_frame < first_frame where no whole frame lies inside. Empty if the signal is shorter than a window; arguments that window_error names give null.
    """
    window_ms, interval_ms = (x if isinstance(x, Column) else F.lit(x) for x in (window_ms, interval_ms))
    length, step = samples_for_ms(window_ms), samples_for_ms(interval_ms)
    room = n_samples.cast("long") - length
    safe = F.greatest(step, F.lit(1))
    starts = F.when(room < 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), quotient(F.greatest(room, F.lit(0)), safe)), lambda k: k * step))

    def one(start: Column, i: Column) -> Column:
        first = quotient(start + HOP_SIZE - 1, HOP_SIZE)
        last = quotient(start + length - FRAME_SIZE, HOP_SIZE)
        return F.struct(i.cast("long").alias("window_idx"), start.alias("start"), ms_for_samples(start).alias("timestamp_ms"), window_ms.cast("long").alias("duration_ms"), first.alias("first_frame"), last.alias("last_frame"))

    return F.when(window_error(window_ms, interval_ms).isNull(), F.transform(starts, one))


def hash_starts(n_frames: Column) -> Column:
    """The frames at which the hashes of a span of n_frames begin: every second one with seven to follow, and the last such frame."""
    last = n_frames.cast("long") - 8
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(F.array_union(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0)), F.lit(2).cast("long")), F.array(last)))
