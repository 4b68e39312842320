"""From encoded blobs or raw samples to hashes: decoding, blocks of frames, hashes by frame, and windows.

A blob is decoded once, and its signal cut into blocks of frames that overlap by what a hash looks ahead; blocks are dealt over the cluster, so one long recording is spread. A block computes the hash
that begins at each of its frames, once for all windows that share it. Windows are made by the block in which they begin, with the hashes that it lacks from its neighbours.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolith.constants import FRAME_SIZE, FRAMES_PER_HASH, HASH_STRIDE, HOP_SIZE, TARGET_RATE, U32_MAX
from echolith.errors import SignalError
from echolith.functions import dsp, grid
from echolith.sources.wave import decode

BLOCK_FRAMES = 2_048
_BLOCKS = "id string, n_samples long, first_frame long, block_frames int, samples binary, error struct<code:string,message:string>"


def _block_rows(key: str, mono: np.ndarray, frames: int) -> pa.RecordBatch:
    """The blocks of a signal at the target rate (one without samples if it holds no hash)."""
    firsts = list(range(0, max(1, dsp.frame_count(len(mono)) - FRAMES_PER_HASH + 1), frames))
    ends = [(f + frames + FRAMES_PER_HASH - 2) * HOP_SIZE + FRAME_SIZE for f in firsts]
    return pa.RecordBatch.from_arrays(
        [pa.array([key] * len(firsts)), pa.array([len(mono)] * len(firsts), pa.int64()), pa.array(firsts, pa.int64()), pa.array([frames] * len(firsts), pa.int32()), pa.array([mono[f * HOP_SIZE : e].astype("<f4").tobytes() for f, e in zip(firsts, ends, strict=True)], pa.binary()), pa.nulls(len(firsts), pa.struct([("code", pa.string()), ("message", pa.string())]))],
        names=["id", "n_samples", "first_frame", "block_frames", "samples", "error"],
    )


def decoded_blocks(blobs: DataFrame, block_frames: int = BLOCK_FRAMES, mpeg=None) -> DataFrame:
    """id, n_samples, first_frame, block_frames, samples, error: the blocks of each blob (id, content) at the target rate, or one row with the error that it has."""

    def run(batches):
        for batch in batches:
            for key, content in zip(batch.column("id").to_pylist(), batch.column("content"), strict=True):
                try:
                    audio = decode(content.as_py() or b"", mpeg)
                    dsp.check_shape(audio.rate, audio.channels)
                    yield _block_rows(key, dsp.resample(dsp.downmix(audio.samples, audio.channels), audio.rate), block_frames)
                except SignalError as e:
                    yield pa.RecordBatch.from_pydict({"id": [key], "n_samples": pa.array([None], pa.int64()), "first_frame": pa.array([None], pa.int64()), "block_frames": pa.array([block_frames], pa.int32()), "samples": pa.array([None], pa.binary()), "error": pa.array([{"code": e.code, "message": e.message}], pa.struct([("code", pa.string()), ("message", pa.string())]))})

    return blobs.select(F.col("id").cast("string").alias("id"), "content").mapInArrow(run, _BLOCKS)


def sample_blocks(signals: DataFrame, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """The same for signals (id, samples array of float) that are mono at the target rate already."""

    def run(batches):
        for batch in batches:
            for key, samples in zip(batch.column("id").to_pylist(), batch.column("samples"), strict=True):
                yield _block_rows(key, np.asarray(samples.values.to_numpy(zero_copy_only=False) if samples.is_valid else [], np.float32), block_frames)

    return signals.select(F.col("id").cast("string").alias("id"), F.col("samples").cast("array<float>").alias("samples")).mapInArrow(run, _BLOCKS)


def frames_of(blocks: DataFrame, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """id, frame_idx, chroma: every frame's pitch-class energies."""

    def run(batches):
        for batch in batches:
            for key, first, raw in zip(batch.column("id").to_pylist(), batch.column("first_frame").to_pylist(), batch.column("samples"), strict=True):
                frames = dsp.chroma(np.frombuffer(raw.as_py(), "<f4"))
                frames = frames if len(frames) < block_frames + FRAMES_PER_HASH - 1 else frames[:block_frames]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(frames), pa.string()), pa.array(first + np.arange(len(frames)), pa.int64()), pa.array(frames.tolist(), pa.list_(pa.float32()))], names=["id", "frame_idx", "chroma"])

    return blocks.filter("error is null").select("id", "first_frame", "samples").mapInArrow(run, "id string, frame_idx long, chroma array<float>")


def frame_hashes(blocks: DataFrame) -> DataFrame:
    """id, frame_idx, hash: the hash that begins at each frame with seven to follow."""

    def run(batches):
        for batch in batches:
            for key, first, raw in zip(batch.column("id").to_pylist(), batch.column("first_frame").to_pylist(), batch.column("samples"), strict=True):
                hashes = dsp.frame_hashes(dsp.chroma(np.frombuffer(raw.as_py(), "<f4")))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(hashes), pa.string()), pa.array(first + np.arange(len(hashes)), pa.int64()), pa.array(hashes, pa.int64())], names=["id", "frame_idx", "hash"])

    return blocks.filter("error is null").select("id", "first_frame", "samples").mapInArrow(run, "id string, frame_idx long, hash long")


_HASHED = "id string, n_samples long, first_frame long, block_frames int, hashes array<long>, error struct<code:string,message:string>"


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat, pa.int64()))


def hashed_blocks(blocks: DataFrame, whole_signal: bool = False) -> DataFrame:
    """id, n_samples, first_frame, block_frames, hashes (of the frames from first_frame on), error: every block with its hashes in place of its samples. With whole_signal only those that the signal as one span has."""

    def run(batches):
        for batch in batches:
            for at, raw in enumerate(batch.column("samples")):
                one = batch.slice(at, 1)
                hashes = dsp.frame_hashes(dsp.chroma(np.frombuffer(raw.as_buffer(), "<f4"))) if raw.is_valid else np.zeros(0, np.int64)
                if whole_signal and len(hashes):
                    n, first = one.column("n_samples")[0].as_py(), one.column("first_frame")[0].as_py()
                    frame = first + np.arange(len(hashes))
                    hashes = hashes[(frame % HASH_STRIDE == 0) | (frame == dsp.frame_count(n) - FRAMES_PER_HASH)]
                yield pa.RecordBatch.from_arrays([*[one.column(c) for c in ("id", "n_samples", "first_frame", "block_frames")], _lists(hashes, np.array([len(hashes)])), one.column("error")], names=["id", "n_samples", "first_frame", "block_frames", "hashes", "error"])

    return blocks.mapInArrow(run, _HASHED)


def signatures(blocks: DataFrame) -> DataFrame:
    """id, n_samples, duration_ms, hashes, error of each whole signal. Every block gives the hashes that the signal keeps; only these come together, 1/256 of its samples."""
    part = F.struct("first_frame", "hashes")
    signal = hashed_blocks(blocks, whole_signal=True).groupBy("id").agg(F.first("n_samples").alias("n_samples"), F.sort_array(F.collect_set(part)).alias("parts"), F.first("error", ignorenulls=True).alias("error"))
    return signal.select("id", "n_samples", grid.ms_for_samples(F.col("n_samples")).alias("duration_ms"), F.when(F.col("error").isNull(), F.flatten(F.col("parts.hashes"))).alias("hashes"), "error")


def with_halo(hashed: DataFrame, frames: int) -> DataFrame:
    """hashed blocks, each with the hashes of so many more frames, which begin in the blocks after it.

    Every block sends its head to those before it that lack it: an exchange between neighbours, so no row holds more of a signal than a block and its halo.
    """
    size = F.col("block_frames")
    head = lambda k: F.when(k == 0, F.col("hashes")).otherwise(F.slice("hashes", 1, F.greatest(F.lit(0), frames - (k - 1) * size)))
    hop = lambda k: F.struct((F.col("first_frame") - k * size).alias("to"), head(k).alias("hashes"))
    reach = F.ceil(F.lit(frames) / size).cast("int")
    sent = hashed.select("id", "n_samples", "first_frame", "block_frames", "error", F.explode(F.transform(F.sequence(F.lit(0), reach), hop)).alias("x"))
    part = F.struct("first_frame", "x.hashes")
    met = sent.filter("x.to is null or x.to >= 0").groupBy("id", F.col("x.to").alias("first_frame")).agg(F.first("n_samples").alias("n_samples"), F.first("block_frames").alias("block_frames"), F.sort_array(F.collect_set(part)).alias("parts"), F.first("error", ignorenulls=True).alias("error"))
    return met.select("id", "n_samples", "first_frame", "block_frames", F.flatten("parts.hashes").alias("hashes"), "error")


#: Hashes of windows that are put out together, about.
_OUT_HASHES = 1 << 19


def _block_windows(n_samples: int, first_frame: int, block_frames: int, length: int, step: int) -> tuple[int, int]:
    """first and end of the windows whose first frame lies in a block (the last block has all that follow)."""
    low = 0 if first_frame == 0 else (first_frame - 1) * HOP_SIZE // step + 1
    last = first_frame + block_frames >= dsp.frame_count(n_samples) - FRAMES_PER_HASH + 1
    end = 0 if n_samples < length else (n_samples - length) // step + 1
    return low, end if last else min(end, (first_frame + block_frames - 1) * HOP_SIZE // step + 1)


def windows_of(hashed: DataFrame, window_ms: int, interval_ms: int) -> DataFrame:
    """id, window_idx, timestamp_ms, duration_ms, hashes, error: every complete window of each signal of hashed blocks; a signal with an error, or unusable arguments, give one row with the error.

    A block has the windows that begin in it, and gets the hashes that these lack from the blocks after it. Memory goes with a block and a window, however long the signal is.
    """
    try:
        length, step = dsp.window_samples(window_ms, interval_ms)
    except SignalError as e:
        fault = F.struct(F.lit(e.code).alias("code"), F.lit(e.message).alias("message"))
        once = hashed.filter("first_frame is null or first_frame = 0")
        return once.select("id", *[F.lit(None).cast(t).alias(c) for c, t in (("window_idx", "long"), ("timestamp_ms", "long"), ("duration_ms", "long"), ("hashes", "array<long>"))], F.coalesce("error", fault).alias("error"))

    def run(batches):
        starts_of = lru_cache(maxsize=8)(dsp.span_starts)
        for batch in batches:
            for at, (n, first_frame, block_frames, error) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("n_samples", "first_frame", "block_frames")], batch.column("error"), strict=True)):
                names = ["id", "window_idx", "timestamp_ms", "duration_ms", "hashes", "error"]
                if error.is_valid:
                    none = pa.nulls(1, pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, 1), none, none, none, pa.nulls(1, pa.list_(pa.int64())), batch.column("error").slice(at, 1)], names=names)
                    continue
                hashes = batch.column("hashes")[at].values.to_numpy()
                low, end = _block_windows(n, first_frame, block_frames, length, step)
                together = max(1, _OUT_HASHES // max(1, length // (HASH_STRIDE * HOP_SIZE)))
                for k in range(low, end, together):
                    index = np.arange(k, min(end, k + together))
                    start = index * step
                    first, last = -(-start // HOP_SIZE), (start + length - FRAME_SIZE) // HOP_SIZE
                    frames = np.maximum(last - first + 1, 0)
                    picks = [first[i] - first_frame + starts_of(int(frames[i])) for i in range(len(index))]
                    flat = hashes[np.concatenate([np.zeros(0, np.int64), *picks])]
                    key = pa.array([batch.column("id")[at].as_py()] * len(index), pa.string())
                    stamps = np.minimum((start * 1000 + TARGET_RATE // 2) // TARGET_RATE, U32_MAX)
                    yield pa.RecordBatch.from_arrays([key, pa.array(index, pa.int64()), pa.array(stamps, pa.int64()), pa.array(np.full(len(index), window_ms), pa.int64()), _lists(flat, np.array([len(p) for p in picks])), pa.nulls(len(index), batch.column("error").type)], names=names)

    most = (length - FRAME_SIZE) // HOP_SIZE + 1
    return with_halo(hashed, most).mapInArrow(run, "id string, window_idx long, timestamp_ms long, duration_ms long, hashes array<long>, error struct<code:string,message:string>")


def windowed(blocks: DataFrame, window_ms: int, interval_ms: int) -> DataFrame:
    """The windows of blocks of samples."""
    return windows_of(hashed_blocks(blocks), window_ms, interval_ms)
