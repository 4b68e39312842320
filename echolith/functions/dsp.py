"""Signal kernels on one block of samples (numpy, float32), for use inside Spark tasks."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from echolith.constants import BAND_HIGH_HZ, BAND_LOW_HZ, DELTA_THRESHOLD, FRAME_SIZE, HOP_SIZE, MAX_SOURCE_RATE, PITCH_CLASSES, RESAMPLER_LOBES, RESAMPLER_PHASES, RESAMPLER_ROLLOFF, TARGET_RATE, TUNING_CLASS, TUNING_HZ
from echolith.errors import SignalError

#: Outputs made together: few enough that their windows stay small at the highest source rate.
_AT_ONCE = 1 << 12
#: Outputs of whole periods that are made together, and samples that these see: they stay in a core's cache.
_CELLS_AT_ONCE, _SEEN_AT_ONCE = 1 << 16, 1 << 18
#: Up to this source position, and so many outputs in a period, doubles and whole numbers give every output but a period's first the same place.
_SURE, _LONGEST_PERIOD = 1 << 28, 1 << 11
#: Frames made together: their spectra stay in a core's cache.
_FRAMES_AT_ONCE = 16


def check_shape(rate: int, channels: int) -> None:
    if rate == 0:
        raise SignalError("invalid", "sample rate must be greater than 0")
    if rate > MAX_SOURCE_RATE:
        raise SignalError("invalid", f"sample rate must be at most {MAX_SOURCE_RATE} Hz")
    if channels == 0:
        raise SignalError("invalid", "channel count must be greater than 0")


def frame_count(n: int) -> int:
    """How many whole frames n samples hold."""
    return 0 if n < FRAME_SIZE else (n - FRAME_SIZE) // HOP_SIZE + 1


def window_samples(window_ms: int | None, interval_ms: int | None) -> tuple[int, int]:
    """Length and step of windows in samples; a SignalError for unusable ones (a missing value counts as 0)."""
    length, step = ((ms or 0) * TARGET_RATE // 1000 for ms in (window_ms, interval_ms))
    if length < FRAME_SIZE:
        raise SignalError("invalid", f"Window too short: {length} samples, need at least {FRAME_SIZE}")
    if step == 0:
        raise SignalError("invalid", "Window interval must be greater than 0")
    return length, step


def downmix(samples: np.ndarray, channels: int) -> np.ndarray:
    """Interleaved float32 or int16 samples as the mean over channels; a partial frame at the end is dropped."""
    channels = max(1, channels)
    frames = samples[: len(samples) // channels * channels].reshape(-1, channels)
    total = np.zeros(len(frames), np.float32)
    for c in range(channels):
        total = total + frames[:, c].astype(np.float32)
    if samples.dtype == np.int16:
        return total * np.float32(2.0**-15 / channels) if channels == 1 else total * np.float32(1 / 32_768) / np.float32(channels)
    return total if channels == 1 else total / np.float32(channels)


class Resampler:
    """A bank of windowed-sinc filters for one source rate; output n lies at source position n * ratio, snapped down to the phase grid."""

    def __init__(self, rate: int):
        self.ratio = rate / TARGET_RATE
        cutoff = 0.5 * min(1 / self.ratio, 1.0) * RESAMPLER_ROLLOFF
        self.half = int(np.ceil(RESAMPLER_LOBES / (2 * cutoff)))
        self.taps = 2 * self.half + 2
        t = np.arange(self.taps)[None, :] - self.half - np.arange(RESAMPLER_PHASES)[:, None] / RESAMPLER_PHASES
        inside = np.abs(t) <= self.half
        angle = np.pi * t / self.half
        filters = np.where(inside, np.sinc(2 * cutoff * t) * (0.42 + 0.5 * np.cos(angle) + 0.08 * np.cos(2 * angle)), 0.0)
        self.filters = filters.astype(np.float32) * (1 / filters.sum(axis=1, keepdims=True)).astype(np.float32)
        self.by_tap = np.ascontiguousarray(self.filters.T)
        # So many outputs span so many source samples; then bases and phases come again.
        divisor = math.gcd(rate, TARGET_RATE)
        self.period, self.step = TARGET_RATE // divisor, rate // divisor
        if self.period <= _LONGEST_PERIOD:
            place = np.arange(self.period) * self.step
            self.bases = place // self.period
            self.by_place = np.ascontiguousarray(self.by_tap[:, place % self.period * RESAMPLER_PHASES // self.period, None])

    def length(self, frames: int) -> int:
        return int(np.floor(frames / self.ratio))

    def first_source(self, n: int) -> int:
        return int(np.floor(n * self.ratio)) - self.half

    def last_source(self, n: int) -> int:
        return int(np.floor(n * self.ratio)) + self.half + 1

    def outputs(self, source: np.ndarray, start: int, first: int, end: int) -> np.ndarray:
        """Outputs first to end from samples whose first has the index start in the whole signal; samples that aren't there count as zero."""
        if self.period <= _LONGEST_PERIOD and end - first >= 4 * self.period and end * self.ratio < _SURE:
            low, high, together = first // self.period, -(-end // self.period), max(16, min(_CELLS_AT_ONCE // self.period, _SEEN_AT_ONCE // (self.step + self.taps)))
            out = np.concatenate([self._periods(source, start, p, min(high, p + together)) for p in range(low, high, together)])
            return out[first - low * self.period : end - low * self.period]
        return np.concatenate([np.zeros(0, np.float32), *[self._singly(source, start, np.arange(at, min(end, at + _AT_ONCE))) for at in range(first, end, _AT_ONCE)]])

    def _seen(self, source: np.ndarray, start: int, low: int, high: int) -> np.ndarray:
        """The samples low to high of the whole signal, with zeros where there are none."""
        seen, low, high = np.zeros(high - low, np.float32), low - start, high - start
        there = slice(max(0, low), max(0, min(high, len(source))))
        if there.stop > there.start:
            seen[there.start - low : there.stop - low] = source[there]
        return seen

    def _summed(self, shape: tuple[int, ...], tap) -> np.ndarray:
        """Four running sums in order, then the rest: float32 addition in this order is part of the format. Tap by tap, so that all work is on short arrays."""
        sums, whole = np.zeros((5, *shape), np.float32), self.taps // 4 * 4
        for k in range(self.taps):
            sums[k % 4 if k < whole else 4] += tap(k)
        return (sums[0] + sums[1]) + (sums[2] + sums[3]) + sums[4]

    def _singly(self, source: np.ndarray, start: int, outputs: np.ndarray) -> np.ndarray:
        """These outputs, ascending; each tap and sample is fetched."""
        position = outputs * self.ratio
        base = np.floor(position)
        phase = np.minimum(((position - base) * RESAMPLER_PHASES).astype(np.int64), RESAMPLER_PHASES - 1)
        index = base.astype(np.int64) - self.half
        seen, index = self._seen(source, start, int(index[0]), int(index[-1]) + self.taps), index - index[0]

        def tap(k):
            out = self.by_tap[k].take(phase)
            out *= seen[k:].take(index)
            return out

        return self._summed(index.shape, tap)

    def _periods(self, source: np.ndarray, start: int, first: int, end: int) -> np.ndarray:
        """The outputs of whole periods, one row for each place in a period: in a row the tap is the same, and the samples lie a step apart."""
        low, count = first * self.step - self.half, end - first
        seen = self._seen(source, start, low, low + count * self.step + self.taps)
        rows = np.ascontiguousarray(np.lib.stride_tricks.as_strided(seen, (self.step + self.taps, count), (4, 4 * self.step)))
        held = np.empty((self.period, count), np.float32)

        def tap(k):
            rows.take(self.bases + k, axis=0, out=held, mode="clip")
            np.multiply(held, self.by_place[k], out=held)
            return held

        out = self._summed(held.shape, tap).T.copy()
        # In doubles a period's first output may lie a little before its place.
        whole = np.arange(first, end)
        early = whole[whole * self.period * self.ratio < whole * self.step]
        if len(early):
            out[early - first, 0] = self._singly(source, start, early * self.period)
        return out.ravel()


@lru_cache(maxsize=16)
def resampler(rate: int) -> Resampler:
    return Resampler(rate)


def resample(mono: np.ndarray, rate: int) -> np.ndarray:
    """A whole mono signal at the target rate; empty for an unusable rate."""
    if rate == TARGET_RATE:
        return mono.astype(np.float32, copy=False)
    if not 0 < rate <= MAX_SOURCE_RATE or not len(mono):
        return np.zeros(0, np.float32)
    bank = resampler(rate)
    return bank.outputs(mono, 0, 0, bank.length(len(mono)))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The window, the bins in the band ordered by pitch class, and where each class begins among them."""
    n = np.arange(FRAME_SIZE, dtype=np.float32)
    hann = (np.float32(0.5) * (np.float32(1) - np.cos(np.float32(2 * np.pi) * n / np.float32(FRAME_SIZE - 1)))).astype(np.float32)
    hz = np.arange(FRAME_SIZE // 2 + 1) * (TARGET_RATE / FRAME_SIZE)
    bins = np.flatnonzero((hz >= BAND_LOW_HZ) & (hz < BAND_HIGH_HZ))
    pitch = np.floor(np.mod(np.log2(hz[bins] / TUNING_HZ) * 12 + TUNING_CLASS, 12)).astype(int)
    order = np.argsort(pitch, kind="stable")
    return hann, bins[order], np.searchsorted(pitch[order], np.arange(PITCH_CLASSES))


def chroma(samples: np.ndarray, first: int = 0, end: int | None = None) -> np.ndarray:
    """Frames first to end of a signal at the target rate: twelve pitch-class energies of unit length each (zeros for silence)."""
    count = frame_count(len(samples))
    end = count if end is None else min(end, count)
    hann, bins, starts = _tables()
    sizes = np.diff(np.append(starts, len(bins))).astype(np.float32)
    out = [np.zeros((0, PITCH_CLASSES), np.float32)]
    for at in range(first, end, _FRAMES_AT_ONCE):
        frames = np.lib.stride_tricks.sliding_window_view(samples[at * HOP_SIZE : (min(end, at + _FRAMES_AT_ONCE) - 1) * HOP_SIZE + FRAME_SIZE], FRAME_SIZE)[::HOP_SIZE]
        spectrum = np.fft.rfft(frames * hann, axis=1).take(bins, axis=1)
        magnitude = np.sqrt(spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        energy = np.add.reduceat(magnitude * magnitude, starts, axis=1).astype(np.float32) / sizes
        norm = np.sqrt((energy * energy).sum(axis=1, dtype=np.float32))[:, None]
        out.append(np.where(norm > 1e-6, energy / np.maximum(norm, np.float32(1e-30)), energy).astype(np.float32))
    return np.concatenate(out)


def frame_hashes(frames: np.ndarray) -> np.ndarray:
    """The hash that begins at each frame that seven follow."""
    n = max(0, len(frames) - 7)
    if not n:
        return np.zeros(0, np.int64)
    rise = frames[1:] - frames[:-1] > np.float32(DELTA_THRESHOLD)
    weight = 1 << np.arange(PITCH_CLASSES, dtype=np.int64)
    bits = rise @ weight
    total = np.zeros(n, np.float32)
    for c in range(PITCH_CLASSES):
        total = total + frames[:n, c]
    energy = np.clip(np.nan_to_num(total * np.float32(4), nan=0.0), 0, 15).astype(np.int64)
    return (bits[:n] | (bits[1 : n + 1] << 12) | ((bits[2 : n + 2] & 15) << 24)) ^ (energy << 28)


def span_starts(n: int) -> np.ndarray:
    """Where the hashes of a span of n frames begin."""
    return np.zeros(0, np.int64) if n < 8 else np.union1d(np.arange(0, n - 7, 2), [n - 8])
