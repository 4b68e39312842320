"""Incremental signatures in Structured Streaming.

Rows of a stream carry chunk_seq, the only clock: chunks are applied in this order whatever order they arrive in, early ones wait in the state, and repeated ones are dropped. State per
stream is bounded by the resampler's reach, less than a frame of samples, the frames that a hash or window can still need, and so many early chunks. What cannot be used gives a row with code and message.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from echolith.constants import DEFAULT_INTERVAL_MS, DEFAULT_WINDOW_MS, FRAME_SIZE, FRAMES_PER_HASH, HASH_STRIDE, HOP_SIZE, PITCH_CLASSES, TARGET_RATE, U32_MAX
from echolith.errors import SignalError
from echolith.functions import dsp, grid

#: op is open, push, flush, reset or close; format is i16 or f32 (little-endian, interleaved). An open row, or else the first push of usable shape, fixes a stream's rate and the channels of its i16 chunks; later rows may leave
#: the rate out. A further open row starts the stream anew (in the next epoch). Before a stream is open, flush, reset and close do nothing.
#: A close row flushes and lets the stream go: of its state only numbers stay, so that repeated chunks are still known; a later open row or push starts it anew in the next epoch. Float chunks without channels are not there.
CHUNKS = "stream_id string, chunk_seq long, op string, format string, sample_rate long, channels int, pcm binary"
#: Rows with a code are errors of the chunk chunk_seq; in others chunk_seq, code and message are null.
_FAULT = "chunk_seq long, code string, message string"
HASHES = f"stream_id string, epoch long, hash_idx long, hash long, duration_ms long, {_FAULT}"
WINDOWS = f"stream_id string, epoch long, window_idx long, timestamp_ms long, duration_ms long, hashes array<long>, {_FAULT}"
#: So many chunks of a stream wait at most; with more, those that are missing before the first of them are given up.
EARLY_CHUNKS = 1_024
_STATE = "rate long, channels int, kept binary, kept_from long, made long, pending binary, frames binary, first_frame long, total long, next_start long, emitted long, epoch long, next_seq long"


def ms_for_samples(n: int) -> int:
    return min((n * 1000 + TARGET_RATE // 2) // TARGET_RATE, U32_MAX)


class Signal:
    """One stream's state, and what chunks do to it."""

    def __init__(self, rate: int, channels: int):
        self.epoch = self.next_seq = 0
        self.open(rate, channels)

    def open(self, rate: int, channels: int) -> None:
        self.rate, self.channels = rate, channels
        self._clear()

    def _clear(self) -> None:
        self.kept, self.pending = np.zeros(0, np.float32), np.zeros(0, np.float32)
        self.frames = np.zeros((0, PITCH_CLASSES), np.float32)
        self.kept_from = self.made = self.first_frame = self.total = self.next_start = self.emitted = 0

    def packed(self) -> tuple:
        return (self.rate, self.channels, self.kept.tobytes(), self.kept_from, self.made, self.pending.tobytes(), self.frames.tobytes(), self.first_frame, self.total, self.next_start, self.emitted, self.epoch, self.next_seq)

    @classmethod
    def unpacked(cls, row) -> Signal:
        out = cls(row[0], row[1])
        out.kept, out.pending = np.frombuffer(row[2], np.float32), np.frombuffer(row[5], np.float32)
        out.frames = np.frombuffer(row[6], np.float32).reshape(-1, PITCH_CLASSES)
        out.kept_from, out.made = row[3], row[4]
        out.first_frame, out.total, out.next_start, out.emitted, out.epoch, out.next_seq = row[7:13]
        return out

    def apply(self, op: str, form: str, channels: int, pcm: bytes | None) -> None:
        if op == "reset":
            self._clear()
            self.epoch += 1
        elif op in ("flush", "close"):
            self._release()
        elif form == "i16":
            self._push(dsp.downmix(np.frombuffer(pcm or b"", "<i2"), self.channels))
        elif channels > 0:  # a float chunk without channels is not there
            self._push(dsp.downmix(np.frombuffer(pcm or b"", "<f4"), channels))

    def close(self) -> None:
        self.open(0, 0)
        self.epoch += 1

    def _push(self, mono: np.ndarray) -> None:
        if self.rate == TARGET_RATE:
            return self._frame(mono)
        bank = dsp.resampler(self.rate)
        self.kept = np.concatenate([self.kept, mono])
        have = self.kept_from + len(self.kept)
        end = max(self.made, int((have - bank.half) / bank.ratio) - 1)
        while bank.last_source(end) < have:
            end += 1
        while end > self.made and bank.last_source(end - 1) >= have:
            end -= 1
        out = bank.outputs(self.kept, self.kept_from, self.made, end)
        self.made = end
        drop = min(max(0, bank.first_source(end) - self.kept_from), len(self.kept))
        self.kept, self.kept_from = self.kept[drop:], self.kept_from + drop
        return self._frame(out)

    def _release(self) -> None:
        """Outputs that still lack right context, with silence for it; later chunks start without left context."""
        if self.rate != TARGET_RATE:
            bank = dsp.resampler(self.rate)
            have = self.kept_from + len(self.kept)
            end = max(self.made, bank.length(have))
            out = bank.outputs(self.kept, self.kept_from, self.made, end)
            self.made, self.kept, self.kept_from = end, self.kept[:0], have
            self._frame(out)

    def _frame(self, samples: np.ndarray) -> None:
        self.total += len(samples)
        self.pending = np.concatenate([self.pending, samples])
        new = dsp.chroma(self.pending)
        self.frames = np.concatenate([self.frames, new])
        self.pending = self.pending[len(new) * HOP_SIZE :]

    def take_hashes(self) -> np.ndarray:
        """The hashes that have become due, every second frame; no final one, as more may follow."""
        n = max(0, (len(self.frames) - FRAMES_PER_HASH) // HASH_STRIDE + 1)
        out = dsp.frame_hashes(self.frames)[: HASH_STRIDE * n : HASH_STRIDE] if n else np.zeros(0, np.int64)
        self.frames, self.emitted = self.frames[HASH_STRIDE * n :], self.emitted + n
        return out

    def take_windows(self, length: int, step: int) -> list[tuple[int, int, np.ndarray]]:
        """(index, start, hashes) of the windows that have become complete."""
        out = []
        while self.next_start + length <= self.total:
            first, last = -(-self.next_start // HOP_SIZE), (self.next_start + length - FRAME_SIZE) // HOP_SIZE
            span = self.frames[first - self.first_frame : last + 1 - self.first_frame] if first <= last else self.frames[:0]
            out.append((self.emitted, self.next_start, dsp.frame_hashes(span)[dsp.span_starts(len(span))]))
            self.next_start, self.emitted = self.next_start + step, self.emitted + 1
        drop = min(max(0, -(-self.next_start // HOP_SIZE) - self.first_frame), len(self.frames))
        self.frames, self.first_frame = self.frames[drop:], self.first_frame + drop
        return out


def _number(x) -> int:
    """A whole number that may be missing."""
    return 0 if x is None or x != x else int(x)


class _Processor(StatefulProcessor):
    """Applies a stream's chunks in order and gives what has become due.

    With idle_ms the state of a stream without rows for so long is removed; chunks that were waiting then are applied first.
    """

    idle_ms: int | None = None
    early_chunks = EARLY_CHUNKS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.signal = handle.getValueState("signal", _STATE)
        self.early = handle.getMapState("early", "seq long", "op string, format string, rate long, channels int, pcm binary")

    def _applied(self, key: str, at: Signal, seq: int, chunk: tuple) -> list[tuple]:
        """The rows that a chunk makes due, or one with its error. A stream that is not open yet has the rate 0."""
        op, form, rate, channels, pcm = chunk
        if op == "push" and form == "f32" and channels == 0:
            return []
        try:
            if op == "open" or (op == "push" and at.rate == 0):
                dsp.check_shape(rate, channels)
                again = at.rate != 0
                at.open(rate, channels)
                if again:
                    at.epoch += 1
            if at.rate == 0 or op == "open":
                return []
            at.apply(op, form, channels, pcm)
            out = [(*row, None, None, None) for row in self.due(key, at)]
            if op == "close":
                at.close()
            return out
        except SignalError as e:
            return [self._fault(key, at, seq, e)]

    def _fault(self, key: str, at: Signal, seq: int, error: SignalError) -> tuple:
        return (key, at.epoch, *[None] * (len(self.columns) - 5), seq, error.code, error.message)

    def _drained(self, key: str, at: Signal, waiting: dict[int, tuple], most: int) -> list[tuple]:
        """What chunks give that are next in order; missing ones are given up while more than most are waiting."""
        out, seqs = [], {r[0] for r in self.early.keys()}
        while seqs or waiting:
            if at.next_seq not in waiting and at.next_seq not in seqs:
                if len(seqs | waiting.keys()) <= most:
                    break
                first = min(seqs | waiting.keys())
                out.append(self._fault(key, at, at.next_seq, SignalError("invalid", f"chunks {at.next_seq} to {first - 1} are missing")))
                at.next_seq = first
            seq = at.next_seq
            chunk = waiting.pop(seq, None)
            if seq in seqs:
                chunk = chunk or self.early.getValue((seq,))
                self.early.removeKey((seq,))
                seqs.discard(seq)
            out += self._applied(key, at, seq, chunk)
            at.next_seq = seq + 1
        for seq, chunk in waiting.items():
            self.early.updateValue((seq,), chunk)
        return out

    def _state(self) -> Signal:
        return Signal.unpacked(self.signal.get()) if self.signal.exists() else Signal(0, 0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, waiting = self._state(), {}
        for frame in rows:
            for r in frame.itertuples(index=False):
                if r.chunk_seq >= at.next_seq:
                    waiting.setdefault(int(r.chunk_seq), (r.op, r.format, _number(r.sample_rate), _number(r.channels), r.pcm))
        out = self._drained(key[0], at, waiting, self.early_chunks)
        self.signal.update(at.packed())
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self._state()
        out = self._drained(key[0], at, {}, 0)
        self.signal.clear()
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class HashProcessor(_Processor):
    columns = ["stream_id", "epoch", "hash_idx", "hash", "duration_ms", "chunk_seq", "code", "message"]

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def due(self, key: str, at: Signal) -> list[tuple]:
        first, now = at.emitted, ms_for_samples(at.total)
        return [(key, at.epoch, first + i, int(h), now) for i, h in enumerate(at.take_hashes())]


class WindowProcessor(_Processor):
    columns = ["stream_id", "epoch", "window_idx", "timestamp_ms", "duration_ms", "hashes", "chunk_seq", "code", "message"]

    def __init__(self, window_ms: int, interval_ms: int, idle_ms: int | None = None):
        self.window_ms, self.idle_ms = window_ms, idle_ms
        self.length, self.step = dsp.window_samples(window_ms, interval_ms)

    def due(self, key: str, at: Signal) -> list[tuple]:
        return [(key, at.epoch, i, ms_for_samples(start), self.window_ms, h.tolist()) for i, start, h in at.take_windows(self.length, self.step)]


def chunk_errors(chunks: DataFrame) -> DataFrame:
    """stream_id, chunk_seq, code, message of the open rows and pushes whose own rate or channel count is unusable, of a stream or a table of CHUNKS. Float chunks without channels are not there, and no errors."""
    error = grid.shape_error(F.coalesce("sample_rate", F.lit(0)), F.coalesce("channels", F.lit(0)))
    shaped = F.col("op").isin("open", "push") & ~((F.col("op") == "push") & (F.col("format") == "f32") & (F.coalesce("channels", F.lit(0)) == 0))
    found = chunks.filter(shaped).select("stream_id", "chunk_seq", error.alias("e"))
    return found.filter("e is not null").select("stream_id", "chunk_seq", "e.code", "e.message")


def _streamed(chunks: DataFrame, processor: _Processor, schema: str) -> DataFrame:
    return chunks.groupBy("stream_id").transformWithStateInPandas(processor, schema, "append", "processingTime" if processor.idle_ms else "none")


def stream_hashes(chunks: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """HASHES rows of a stream of CHUNKS; duration_ms is that of the signal so far. With idle_ms the state of a stream that has had no rows for so long is removed; such a query needs a
    processing-time trigger, as one that ends when all is read waits for its timers."""
    return _streamed(chunks, HashProcessor(idle_ms), HASHES)


def stream_windows(chunks: DataFrame, window_ms: int = DEFAULT_WINDOW_MS, interval_ms: int = DEFAULT_INTERVAL_MS, idle_ms: int | None = None) -> DataFrame:
    """WINDOWS rows of a stream of CHUNKS, equal to those of the whole signal."""
    return _streamed(chunks, WindowProcessor(window_ms, interval_ms, idle_ms), WINDOWS)
