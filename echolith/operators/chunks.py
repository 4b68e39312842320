"""Blocks of frames from tables of PCM chunks: one recording is mixed down, resampled and hashed in many tasks.

Every block of frames at the target rate needs a span of source samples: its own, and on either side the reach of the resampler's taps. Each chunk sends every block the part of its samples that lies in the
block's span, mixed down already; a block joins its parts and makes its outputs, at their places in the whole recording. No task holds more of a recording than a block's span.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolith.constants import FRAME_SIZE, FRAMES_PER_HASH, HOP_SIZE, TARGET_RATE
from echolith.functions import dsp, grid
from echolith.operators.signatures import BLOCK_FRAMES

#: Rows are put out together up to so many bytes of samples.
BATCH_BYTES = 1 << 20
_ERROR = pa.struct([("code", pa.string()), ("message", pa.string())])
_PARTS = dict(id=pa.string(), first_frame=pa.int64(), rate=pa.int64(), channels=pa.int64(), n_source=pa.int64(), at=pa.int64(), size=pa.int64(), mono=pa.binary(), error=_ERROR)
_MADE = dict(id=pa.string(), n_samples=pa.int64(), first_frame=pa.int64(), block_frames=pa.int32(), samples=pa.binary(), error=_ERROR)
_BLOCKS = "id string, n_samples long, first_frame long, block_frames int, samples binary, error struct<code:string,message:string>"


def frames_for(rate: int, block_frames: int = BLOCK_FRAMES) -> int:
    """Frames of a block, fewer for high source rates, so that its span has about as many samples at any rate."""
    return max(32, math.ceil(block_frames * TARGET_RATE / max(rate, TARGET_RATE)))


def target_length(rate: int, n_source: int) -> int:
    return n_source if rate == TARGET_RATE else dsp.resampler(rate).length(n_source)


def block_span(rate: int, n_source: int, first_frame: int, frames: int) -> tuple[int, int, int, int]:
    """(first, end) of a block's samples at the target rate, and (low, high) of the source samples that they need; the latter may lie outside the recording."""
    first = first_frame * HOP_SIZE
    end = min(target_length(rate, n_source), (first_frame + frames + FRAMES_PER_HASH - 2) * HOP_SIZE + FRAME_SIZE)
    if rate == TARGET_RATE or end <= first:
        return first, max(first, end), first, max(first, end)
    bank = dsp.resampler(rate)
    return first, end, bank.first_source(first), bank.last_source(end - 1) + 1


def block_count(rate: int, n_source: int, frames: int) -> int:
    return max(1, -(-(dsp.frame_count(target_length(rate, n_source)) - FRAMES_PER_HASH + 1) // frames))


def with_places(chunks: DataFrame) -> DataFrame:
    """chunks with first_sample and n_source: where each begins in its recording, and how many samples (of all channels) that has. Only lengths are ordered; PCM is joined to its place.

    Chunks follow each other by chunk_seq, which is theirs alone within an id. A sample that is not whole at a chunk's end does not count.
    """
    size = F.when(F.col("channels") > 0, grid.quotient(F.octet_length("pcm").cast("long"), F.when(F.col("format") == "i16", 2).otherwise(4) * F.col("channels")))
    lengths = chunks.select("id", "chunk_seq", F.coalesce(size, F.lit(0).cast("long")).alias("n"))
    before = Window.partitionBy("id").orderBy("chunk_seq").rowsBetween(Window.unboundedPreceding, -1)
    places = lengths.select("id", "chunk_seq", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_sample"), F.sum("n").over(Window.partitionBy("id")).alias("n_source"))
    return chunks.join(places, ["id", "chunk_seq"])


@lru_cache(maxsize=1)
def _codec() -> pa.Codec:
    return pa.Codec("zstd", 1)


def _batches(rows, types: dict, sized: str):
    """Rows (tuples) as batches of about BATCH_BYTES in the column named."""
    held, n, column = [], 0, list(types).index(sized)
    for row in rows:
        held.append(row)
        n += len(row[column] or b"") + 100
        if n >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types.values(), strict=True)], names=list(types))
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types.values(), strict=True)], names=list(types))


def _joined(parts):
    """Parts (id, first_frame, rate, channels, n_source, at, mono, error) with those that follow each other in a block as one, up to BATCH_BYTES; these come one after another, but for parts of the blocks beside."""
    held = {}
    for row in parts:
        if held and row[0] != next(iter(held))[0]:
            yield from held.values()
            held = {}
        key, before = row[:2], held.get(row[:2])
        if before and row[7] is None and before[2:5] == row[2:5] and before[5] + len(before[6]) // 4 == row[5] and len(before[6]) < BATCH_BYTES:
            held[key] = (*before[:6], before[6] + row[6], None)
        else:
            if before:
                yield before
            held[key] = row
        if len(held) > 4:  # chunks come in order, so the oldest block is done with
            yield held.pop(next(iter(held)))
    yield from held.values()


def _blocks_by(block_frames: int):
    """The function that makes blocks of their parts."""

    def made(batches):
        for batch in batches:
            for key, first_frame, rate, n_source, own, error in zip(*[batch.column(c).to_pylist() for c in ("id", "first_frame", "rate", "n_source", "parts", "error")], strict=True):
                if error:
                    yield (key, None, None, block_frames, None, error)
                    continue
                frames = frames_for(rate, block_frames)
                first, end, low, _ = block_span(rate, n_source, first_frame, frames)
                source = np.concatenate([np.zeros(0, np.float32), *[np.frombuffer(_codec().decompress(p["mono"], p["size"]) if p["size"] else b"", "<f4") for p in own]])
                begin = own[0]["at"]
                if rate == TARGET_RATE:
                    out = source[first - begin : end - begin]
                else:
                    out = dsp.resampler(rate).outputs(source, begin, first, end)
                yield (key, target_length(rate, n_source), first_frame, frames, out.astype("<f4").tobytes(), None)

    def blocks(batches):
        yield from _batches(made(batches), _MADE, "samples")

    return blocks


def chunk_blocks(chunks: DataFrame, block_frames: int = BLOCK_FRAMES, one_shape: bool = False) -> DataFrame:
    """id, n_samples, first_frame, block_frames, samples, error: the blocks of each recording of chunks (id, chunk_seq, format i16 or f32, sample_rate, channels, pcm), or one row with the error that it has.

    first_sample and n_source are made by with_places() if chunks lacks them. A recording's rate and channel count must be usable and the same in all chunks; error rows of chunks (with an error column) pass.
    With one_shape it is known that a recording has either chunks of one usable shape or a single row with an error, as wave_chunks gives them; chunks are read once then.
    Blocks equal those of the whole recording, bit by bit.
    """
    placed = chunks if {"first_sample", "n_source"} <= set(chunks.columns) else with_places(chunks)
    known = F.col("error") if "error" in chunks.columns else F.lit(None).cast("struct<code:string,message:string>")
    shape = grid.shape_error(F.coalesce("sample_rate", F.lit(0)), F.coalesce("channels", F.lit(0)))
    placed = placed.withColumn("error", F.coalesce(known, shape))

    def parts_of(batches):
        names = ["id", "error", "sample_rate", "channels", "n_source", "first_sample", "format"]
        for batch in batches:
            for at, (key, error, rate, channels, n_source, first, form) in enumerate(zip(*[batch.column(c).to_pylist() for c in names], strict=True)):
                if error:
                    yield (key, None, None, None, None, None, None, error)
                    continue
                raw = batch.column("pcm")[at].as_buffer() if batch.column("pcm")[at].is_valid else b""
                kind = "<i2" if form == "i16" else "<f4"
                mono = dsp.downmix(np.frombuffer(raw, kind, len(memoryview(raw)) // np.dtype(kind).itemsize), channels)
                frames = frames_for(rate, block_frames)
                ratio = 1.0 if rate == TARGET_RATE else dsp.resampler(rate).ratio
                count = block_count(rate, n_source, frames)
                # From the first block whose span may end behind the chunk's first sample.
                k = max(0, min(count - 1, int(first / ratio) // (frames * HOP_SIZE) - 2))
                while k < count:
                    _, _, low, high = block_span(rate, n_source, k * frames, frames)
                    a, b = max(first, low), min(first + len(mono), high)
                    if low >= first + len(mono) and k:
                        break
                    if a < b or (k == 0 and first == 0):
                        yield (key, k * frames, rate, channels, n_source, a, mono[a - first : max(a, b) - first].astype("<f4").tobytes(), None)
                    k += 1

    def parts(batches):
        # Parts go by way of disks, so they are packed.
        packed = ((*row[:6], len(row[6] or b""), row[6] and _codec().compress(row[6], asbytes=True), row[7]) for row in _joined(parts_of(batches)))
        yield from _batches(packed, _PARTS, "mono")

    sent = placed.select(F.col("id").cast("string").alias("id"), "format", F.col("sample_rate").cast("long").alias("sample_rate"), F.col("channels").cast("int").alias("channels"), "first_sample", "n_source", "pcm", "error")
    sent = sent.mapInArrow(parts, "id string, first_frame long, rate long, channels long, n_source long, at long, size long, mono binary, error struct<code:string,message:string>")
    met = sent.groupBy("id", "first_frame").agg(F.first("rate").alias("rate"), F.first("n_source").alias("n_source"), F.sort_array(F.collect_list(F.struct("at", "size", "mono"))).alias("parts"), F.first("error").alias("error"))
    if one_shape:
        return met.mapInArrow(_blocks_by(block_frames), _BLOCKS)
    # A recording with an unusable chunk, or of several shapes, has one row with that error; this is known from one small row for each shape.
    shapes = placed.select(F.col("id").cast("string").alias("id"), "error", F.col("sample_rate").cast("long").alias("r"), F.col("channels").cast("int").alias("c")).groupBy("id").agg(F.min("error").alias("error"), ((F.min("r") != F.max("r")) | (F.min("c") != F.max("c"))).alias("mixed"))
    mixed = F.struct(F.lit("invalid").alias("code"), F.lit("sample rate and channel count must not change").alias("message"))
    faults = shapes.select("id", F.coalesce("error", F.when(F.col("mixed"), mixed)).alias("error")).filter("error is not null")
    met = met.filter("first_frame is not null").join(faults.select("id"), "id", "left_anti")
    good = met.mapInArrow(_blocks_by(block_frames), _BLOCKS)
    null = lambda t: F.lit(None).cast(t)
    bad = faults.select("id", null("long").alias("n_samples"), null("long").alias("first_frame"), F.lit(block_frames).cast("int").alias("block_frames"), null("binary").alias("samples"), "error")
    return good.unionByName(bad)
