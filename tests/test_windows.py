"""Windows made by blocks with halos, against windows picked from whole signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolith.functions import dsp
from echolith.operators import signatures as ops


def picked(hashes, n_samples, length, step):
    """Every window of a signal by its definition, from the hashes that begin at each of its frames."""
    for k, start in enumerate(range(0, n_samples - length + 1, step)):
        first, last = -(-start // 1024), (start + length - 4096) // 1024
        yield k, min((start * 1000 + 5512) // 11025, 2**32 - 1), hashes[first + dsp.span_starts(max(0, last - first + 1))].tolist()


def hashed(spark, signals, block_frames):
    """Hashed blocks of signals (id, n_samples, hashes)."""
    rows = []
    for name, n, hashes in signals:
        rows += [(name, n, f, block_frames, hashes[f : f + block_frames].tolist(), None) for f in range(0, max(1, len(hashes)), block_frames)]
    return spark.createDataFrame(rows, ops._HASHED)


@pytest.mark.parametrize("block_frames", [1, 7, 16, 64, 2048])
@pytest.mark.parametrize("window_ms, interval_ms", [(1500, 500), (372, 90), (400, 3_000), (9_000, 250)])
def test_every_block_size(spark, block_frames, window_ms, interval_ms):
    rng = np.random.default_rng(block_frames)
    sizes = {"none": 0, "short": 4095, "one": 4096, "a": 4096 + 7 * 1024, "b": 4096 + 70 * 1024 + 5, "c": 4096 + 6 * 1024 + 1023, "d": 120_000}
    signals = [(k, n, rng.integers(0, 2**32, max(0, dsp.frame_count(n) - 7))) for k, n in sizes.items()]
    length, step = dsp.window_samples(window_ms, interval_ms)
    want = {(name, *w[:2], tuple(w[2])) for name, n, hashes in signals for w in picked(hashes, n, length, step)}
    got = ops.windows_of(hashed(spark, signals, block_frames), window_ms, interval_ms).collect()
    assert {(r.id, r.window_idx, r.timestamp_ms, tuple(r.hashes)) for r in got} == want and len(got) == len(want)
    assert {(r.duration_ms, r.error) for r in got} <= {(window_ms, None)}


def test_blocks_of_samples(spark):
    x = np.random.default_rng(4).standard_normal(200_000).astype(np.float32)
    signal = spark.createDataFrame([("x", x.tolist())], "id string, samples array<float>")
    hashes = dsp.frame_hashes(dsp.chroma(x))
    whole = hashes[dsp.span_starts(dsp.frame_count(len(x)))].tolist()
    for frames in (5, 30, 2048):
        blocks = ops.sample_blocks(signal, frames)
        got = sorted((r.window_idx, r.timestamp_ms, r.hashes) for r in ops.windowed(blocks, 2_000, 700).collect())
        assert got == list(picked(hashes, len(x), 22_050, 7_717))
        assert ops.signatures(blocks).first().hashes == whole


def test_a_day_in_blocks(spark):
    """24 hours, ten seconds every two: rows stay as small as a block's windows, and each is right."""
    n = 24 * 3600 * 11_025
    hashes = np.random.default_rng(5).integers(0, 2**32, dsp.frame_count(n) - 7)
    blocks = hashed(spark, [("day", n, hashes)], ops.BLOCK_FRAMES).repartition(4)
    halo = ops.with_halo(blocks, (110_250 - 4096) // 1024 + 1)
    assert halo.agg(F.max(F.size("hashes"))).first()[0] <= ops.BLOCK_FRAMES + 110
    found = ops.windows_of(blocks, 10_000, 2_000)
    digest = found.select(F.count("*").alias("n"), F.countDistinct("window_idx").alias("k"), F.sum(F.aggregate("hashes", F.lit(0).cast("long"), lambda s, h: (s * 31 + h) % 1_000_003)).alias("sum")).first()
    want = list(picked(hashes, n, 110_250, 22_050))
    total = 0
    for _, _, own in want:
        s = 0
        for h in own:
            s = (s * 31 + h) % 1_000_003
        total += s
    assert tuple(digest) == (len(want), len(want), total)


def test_errors_keep_one_row(spark):
    error = {"code": "decode", "message": "m"}
    rows = [("bad", None, None, 2048, None, error), ("good", 30_000, 0, 2048, list(range(19)), None)]
    blocks = spark.createDataFrame(rows, ops._HASHED)
    assert [(r.id, r.window_idx, r.error and r.error.code) for r in ops.windows_of(blocks, 1500, 90_000).orderBy("id").collect()] == [("bad", None, "decode"), ("good", 0, None)]
    for arguments in ((1, 500), (None, 500), (1500, 0), (1500, None)):
        got = ops.windows_of(blocks, *arguments).orderBy("id").collect()
        assert [(r.id, r.hashes, r.error.code) for r in got] == [("bad", None, "decode"), ("good", None, "invalid")]
