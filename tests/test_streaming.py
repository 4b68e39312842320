"""Streams equal the whole signal, for any chunks and any order of arrival."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echolith.errors import SignalError
from echolith.functions import dsp
from echolith.operators import signatures as ops
from echolith.streaming import signal


def sine(rate, seconds, hz=440):
    return (0.5 * np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)).astype(np.float32)


def applied(samples, rate, size, take):
    at, out = signal.Signal(rate, 1), []
    for i in range(0, len(samples), size):
        at = signal.Signal.unpacked(at.packed())
        at.apply("push", "f32", 1, samples[i : i + size].tobytes())
        out += take(at)
    at.apply("flush", "f32", 1, None)
    return at, out + take(at)


@pytest.mark.parametrize("size", [733, 4096, 11025])
def test_windows_of_chunks_equal_the_whole(size):
    x = sine(11025, 4)
    _, found = applied(x, 11025, size, lambda s: s.take_windows(22050, 5512))
    frames = dsp.chroma(x)
    assert len(found) == (len(x) - 22050) // 5512 + 1
    for i, start, hashes in found:
        span = frames[-(-start // 1024) : (start + 22050 - 4096) // 1024 + 1]
        assert start == 5512 * i and (hashes == dsp.frame_hashes(span)[dsp.span_starts(len(span))]).all()


@pytest.mark.parametrize("size", [64, 1000, 7333])
def test_resampled_chunks_equal_the_whole(size):
    x = sine(44100, 2)
    at, found = applied(x, 44100, size, lambda s: s.take_hashes().tolist())
    whole = dsp.resample(x, 44100)
    assert at.total == len(whole)
    assert found == dsp.frame_hashes(dsp.chroma(whole))[::2].tolist()


def test_first_hash_needs_eleven_thousand_samples():
    at = signal.Signal(11025, 1)
    at.apply("push", "f32", 1, sine(11025, 2)[:11263].tobytes())
    assert len(at.take_hashes()) == 0
    at.apply("push", "f32", 0, b"\0" * 400)
    assert at.total == 11263
    at.apply("push", "f32", 1, b"\0\0\0\0")
    assert len(at.take_hashes()) == 1


def test_window_arguments_are_checked():
    with pytest.raises(SignalError, match="Window too short: 11 samples, need at least 4096"):
        signal.WindowProcessor(1, 500)
    with pytest.raises(SignalError):
        signal.WindowProcessor(1000, 0)


def test_streaming_query_equals_batch(spark, tmp_path):
    x = (sine(11025, 6, 300) * 32767).astype("<i2")
    rows = [("s", i, "push", "i16", 11025, 1, bytearray(x[a : a + 9000].tobytes())) for i, a in enumerate(range(0, len(x), 9000))]
    rows += [("bad", 0, "push", "i16", 0, 1, bytearray(b"\0\0"))]
    src = str(tmp_path / "chunks")
    for part in (rows[3:] + rows[:1], rows[1:3] + rows[:2]):  # late and repeated
        spark.createDataFrame(part, signal.CHUNKS).coalesce(1).write.mode("append").parquet(src)
    for name, build in (("windows", lambda c: signal.stream_windows(c, 2000, 500)), ("hashes", signal.stream_hashes)):
        stream = spark.readStream.schema(signal.CHUNKS).option("maxFilesPerTrigger", 1).parquet(src)
        q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    blocks = ops.sample_blocks(spark.createDataFrame([("s", (x.astype(np.float32) / 32768).tolist())], "id string, samples array<float>"))
    want = {(r.window_idx, r.timestamp_ms, tuple(r.hashes)) for r in ops.windowed(blocks, 2000, 500).collect()}
    faults = [tuple(r) for r in spark.table("windows").filter("code is not null").select("stream_id", "chunk_seq", "code", "message", "hashes").collect()]
    assert faults == [("bad", 0, "invalid", "sample rate must be greater than 0", None)]
    got = spark.table("windows").filter("code is null").collect()
    assert {(r.window_idx, r.timestamp_ms, tuple(r.hashes)) for r in got} == want and len(got) == len(want) == 9
    whole = ops.signatures(blocks).first().hashes
    found = [r.hash for r in spark.table("hashes").filter("code is null").orderBy(F.col("hash_idx")).collect()]
    assert found == whole[: len(found)] and len(whole) - len(found) in (0, 1)


class Held:
    """State in memory, in the place of Spark's."""

    def __init__(self):
        self.values, self.timers = {}, []

    def getValueState(self, name, schema):
        outer = self

        class Value:
            exists = lambda self: name in outer.values
            get = lambda self: outer.values[name]
            update = lambda self, v: outer.values.__setitem__(name, v)
            clear = lambda self: outer.values.pop(name, None)

        return Value()

    def getMapState(self, name, key, value):
        held = self.values.setdefault(name, {})

        class Map:
            keys = lambda self: list(held)
            getValue = lambda self, k: held[k]
            updateValue = lambda self, k, v: held.__setitem__(k, v)
            removeKey = lambda self, k: held.pop(k)

        return Map()

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


def driven(rows, processor=None, held=None):
    """All result rows and error rows of one stream whose chunks (seq, op, format, rate, channels, pcm) arrive in one batch each."""
    held = held or Held()
    processor = processor or signal.HashProcessor()
    processor.init(held)
    found = []
    for row in rows:
        frame = pd.DataFrame([("s", *row)], columns=["stream_id", "chunk_seq", "op", "format", "sample_rate", "channels", "pcm"])
        for out in processor.handleInputRows(("s",), iter([frame]), None):
            found += out.itertuples(index=False)
    return [r for r in found if r.code is None], [(int(r.chunk_seq), r.message) for r in found if r.code is not None]


LOUD = sine(11025, 4).tobytes()


def test_control_rows_before_a_stream_is_open():
    plain, _ = driven([(0, "push", "f32", 11025, 1, LOUD)])
    assert len(plain) > 10
    for before in [(0, "flush", "f32", 0, 0, None)], [(0, "reset", None, None, None, None)], [(0, "push", "f32", 11025, 0, b"")], [(0, "open", "i16", 11025, 1, None)]:
        got, faults = driven([*before, (1, "push", "f32", 11025, 1, LOUD)])
        assert [r.hash for r in got] == [r.hash for r in plain] and faults == []


def test_unusable_chunks_have_one_row_each():
    rows = [(0, "push", "i16", float("nan"), 1, b"ab"), (1, "open", "f32", 400_000, 1, None), (2, "push", "i16", 11025, 0, b"ab"), (3, "open", None, 11025, 1, None), (4, "push", "f32", float("nan"), 1, LOUD)]
    got, faults = driven(rows)
    assert [r.hash for r in got] == [r.hash for r in driven([(0, "push", "f32", 11025, 1, LOUD)])[0]]
    assert faults == [(0, "sample rate must be greater than 0"), (1, "sample rate must be at most 384000 Hz"), (2, "channel count must be greater than 0")]


def test_a_second_open_row_starts_anew():
    got, faults = driven([(0, "push", "f32", 11025, 1, LOUD), (1, "open", None, 22050, 1, None), (2, "push", "f32", None, 1, sine(22050, 4).tobytes())])
    assert faults == [] and {r.epoch for r in got} == {0, 1} and min(r.hash_idx for r in got if r.epoch == 1) == 0
    assert [r.hash for r in got if r.epoch == 1] == [r.hash for r in driven([(0, "push", "f32", 22050, 1, sine(22050, 4).tobytes())])[0]]


def test_missing_chunks_are_given_up():
    processor = signal.HashProcessor()
    processor.early_chunks = 2
    got, faults = driven([(0, "open", None, 11025, 1, None), (2, "push", "f32", None, 1, LOUD[:40_000]), (3, "push", "f32", None, 1, LOUD[40_000:]), (9, "flush", None, None, None, None)], processor)
    assert faults == [(1, "chunks 1 to 1 are missing")] and [r.hash for r in got] == [r.hash for r in driven([(0, "push", "f32", 11025, 1, LOUD)])[0]]


def test_a_closed_stream_keeps_numbers_only():
    """What a close row makes due is what a flush does; the samples and frames go, repeated chunks are still dropped, and a later push starts anew."""
    for processor in (signal.HashProcessor, lambda: signal.WindowProcessor(1_000, 500)):
        rows = [(0, "push", "f32", 8_000, 1, LOUD), (1, "push", "f32", 8_000, 1, LOUD[:4_000])]
        want, held = driven([*rows, (2, "flush", None, None, None, None)], processor())[0], Held()
        got, faults = driven([*rows, (2, "close", None, None, None, None)], processor(), held)
        assert faults == [] and [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]
        assert sum(len(x) for x in held.values["signal"] if isinstance(x, bytes)) == 0
        assert driven(rows, processor(), held) == ([], [])
        again, faults = driven([(3, "push", "f32", 8_000, 1, LOUD), (4, "close", None, None, None, None), (5, "close", None, None, None, None)], processor(), held)
        fresh = driven([(0, "push", "f32", 8_000, 1, LOUD), (1, "flush", None, None, None, None)], processor())[0]
        assert faults == [] and {r.epoch for r in again} == {1} and [str(r[2:]) for r in again] == [str(r[2:]) for r in fresh]


def test_idle_streams_leave_no_state():
    class Now:
        def getCurrentProcessingTimeInMs(self):
            return 1_000

    held, processor = Held(), signal.HashProcessor(50)
    processor.init(held)
    rows = [("s", 0, "open", None, 11025, 1, None), ("s", 2, "push", "f32", None, 1, LOUD)]
    frame = pd.DataFrame(rows, columns=["stream_id", "chunk_seq", "op", "format", "sample_rate", "channels", "pcm"])
    assert all(out.empty for out in processor.handleInputRows(("s",), iter([frame]), Now()))
    assert held.timers == [1_050] and held.values["early"]
    found = [r for out in processor.handleExpiredTimer(("s",), Now(), None) for r in out.itertuples(index=False)]
    assert [r.message for r in found if r.code] == ["chunks 1 to 1 are missing"] and sum(r.code is None for r in found) > 10
    assert held.values == {"early": {}}


def test_timers_run_in_a_query(spark, tmp_path):
    """A stream that was idle is forgotten, so a second chunk 0 of it opens it again."""
    src = str(tmp_path / "chunks")
    put = lambda name: spark.createDataFrame([(name, 0, "push", "f32", 11025, 1, bytearray(LOUD))], signal.CHUNKS).coalesce(1).write.mode("append").parquet(src)
    count = lambda name: spark.table("idle").filter(F.col("stream_id") == name).count()
    put("a")
    stream = spark.readStream.schema(signal.CHUNKS).parquet(src)
    q = signal.stream_hashes(stream, idle_ms=1).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    try:
        deadline = time.time() + 60
        for name, want in (("b", lambda: count("b") > 0), ("a", lambda: count("a") == 2 * count("b"))):
            put(name)
            while not want() and time.time() < deadline:
                time.sleep(1)
        assert count("a") == 2 * count("b") > 0
    finally:
        q.stop()
