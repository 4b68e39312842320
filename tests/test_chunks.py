"""Splittable wave files and resampling over chunk tables, against whole blobs."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolith.constants import TARGET_RATE
from echolith.functions import dsp
from echolith.operators import chunks as ch
from echolith.operators import signatures as ops
from echolith.sources import wave_files
from echolith.sources.wave import encode_wave


def wave(kind, bits, channels, rate, data):
    fmt = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 4) + b"WAVE" + b"junk" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data)) + data


def samples(blocks):
    """Every signal's samples at the target rate, from its blocks; where these overlap they must agree."""
    out = {}
    for r in sorted(blocks.collect(), key=lambda r: (r.id, r.first_frame or 0)):
        if r.error:
            out[r.id] = r.error.code
            continue
        have, piece, at = out.get(r.id, np.zeros(0, np.float32)), np.frombuffer(r.samples, "<f4"), r.first_frame * 1024
        both = min(len(have) - at, len(piece))
        assert both >= 0 and (have[at : at + both].view(np.int32) == piece[:both].view(np.int32)).all()
        out[r.id] = np.concatenate([have, piece[both:]])
    return out


@pytest.mark.parametrize("rate", [1_000, 8_000, 11_025, 44_100, 48_000, 384_000])
def test_resampled_in_parts_equals_the_whole(spark, rate):
    rng = np.random.default_rng(rate)
    n = max(2_000, rate * 3)
    pcm = rng.integers(-30_000, 30_000, (n, 2)).astype("<i2")
    cuts = np.unique(np.append(rng.integers(0, n, 12), [0, n]))
    rows = [("s", i, "i16", rate, 2, bytearray(pcm[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    table = spark.createDataFrame(rows[::-1], "id string, chunk_seq long, format string, sample_rate long, channels int, pcm binary").repartition(3)
    blocks = ch.chunk_blocks(table, 40)
    want = dsp.resample(dsp.downmix(pcm.ravel(), 2), rate)
    got = samples(blocks)["s"]
    assert (got.view(np.int32) == want[: len(got)].view(np.int32)).all()
    assert {r.n_samples for r in blocks.collect()} == {len(want)}
    assert ops.signatures(blocks).first().hashes == dsp.frame_hashes(dsp.chroma(want))[dsp.span_starts(dsp.frame_count(len(want)))].tolist()


def test_odd_recordings(spark):
    rows = [
        ("empty", 0, "f32", 8_000, 1, bytearray(b"")), ("null", 0, "f32", 8_000, 1, None), ("rate", 0, "f32", 0, 1, bytearray(8)), ("rate", 1, "f32", 8_000, 1, bytearray(8)), ("channels", 0, "i16", 8_000, 0, bytearray(8)),
        ("changes", 0, "i16", 8_000, 1, bytearray(8)), ("changes", 1, "i16", 16_000, 1, bytearray(8)), ("partial", 0, "i16", 11_025, 2, bytearray(b"\1\0\3\0\9")), ("partial", 5, "i16", 11_025, 2, bytearray(b"\5\0\7\0")), ("none", 0, "f32", None, None, None),
    ]
    got = {r.id: r for r in ch.chunk_blocks(spark.createDataFrame(rows, "id string, chunk_seq long, format string, sample_rate long, channels int, pcm binary")).collect()}
    assert len(got) == 7 and {k: r.error and r.error.code for k, r in got.items()} == {"empty": None, "null": None, "rate": "invalid", "channels": "invalid", "changes": "invalid", "partial": None, "none": "invalid"}
    assert got["empty"].n_samples == got["null"].n_samples == 0 and np.frombuffer(got["partial"].samples, "<f4").tolist() == [2 / 32768, 6 / 32768]
    assert ch.chunk_blocks(spark.createDataFrame([], "id string, chunk_seq long, format string, sample_rate long, channels int, pcm binary")).count() == 0


def test_files_equal_blobs(spark, tmp_path):
    rng = np.random.default_rng(9)
    files = {
        "mono.wav": encode_wave(rng.integers(-9_000, 9_000, 90_000).astype(np.int16), 8_000, 1), "stereo.wav": encode_wave(rng.integers(-9_000, 9_000, 80_002).astype(np.int16), 44_100, 2),
        "deep.wav": wave(1, 24, 3, 22_050, rng.bytes(9 * 30_000 + 4)), "float.wav": wave(3, 32, 1, TARGET_RATE, rng.standard_normal(50_000).astype("<f4").tobytes()), "byte.wav": wave(1, 8, 1, 16_000, rng.bytes(40_001)),
        "tagged.wav": b"ID3\x03\0\0\0\0\0\x10" + bytes(16) + encode_wave(rng.integers(-9_000, 9_000, 30_000).astype(np.int16), 8_000, 1),
        "none.wav": encode_wave(np.zeros(0, np.int16), 8_000, 1), "zero.bin": b"", "text.txt": b"hello, this is no audio", "cut.wav": encode_wave(np.zeros(500, np.int16), 8_000, 1)[:-1], "alaw.wav": wave(6, 8, 1, 8_000, bytes(10)), "tag.mp3": b"ID3\x03\0\0\0\0\0\x10" + bytes(16) + b"\xff\xfb\x90\0",
    }
    for name, content in files.items():
        (tmp_path / "a").mkdir(exist_ok=True)
        (tmp_path / "a" / name).write_bytes(content)
    blobs = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "id string, content binary")
    want = samples(ops.decoded_blocks(blobs))
    for split, chunk in ((1 << 20, 1 << 16), (10_000, 700)):
        read = wave_files.read_chunks(spark, str(tmp_path), split, chunk).withColumn("id", F.element_at(F.split("id", "/"), -1))
        if split == 10_000:
            assert read.rdd.getNumPartitions() > 40
        got = samples(ch.chunk_blocks(read, 64))
        assert got.keys() == want.keys()
        for name in want:
            if isinstance(want[name], str):
                assert got[name] == want[name], name
            else:
                assert len(got[name]) == len(want[name][: len(got[name])]) and (got[name].view(np.int32) == want[name][: len(got[name])].view(np.int32)).all(), name
    whole = {r.id: (r.hashes, r.n_samples) for r in ops.signatures(ops.decoded_blocks(blobs)).collect()}
    assert {r.id: (r.hashes, r.n_samples) for r in ops.signatures(ch.chunk_blocks(read, 64)).collect()} == whole


def test_a_path_that_is_not_there(spark, tmp_path):
    with pytest.raises(Exception, match="none-such"):
        wave_files.read_chunks(spark, str(tmp_path / "none-such")).count()


def test_ranges_cover_every_file_once():
    files = [("a", 250), ("b", 10), ("c", 95), ("d", 0), ("e", 100)]
    parts = wave_files.split_files(files, 100)
    assert parts == [[("a", 250, 0, 100)], [("a", 250, 100, 200)], [("a", 250, 200, 250)], [("b", 10, 0, 10)], [("e", 100, 0, 100)], [("c", 95, 0, 95), ("d", 0, 0, 1)]]


def test_beyond_two_gigabytes(tmp_path):
    """A file of 2.5 GB (with holes, so it takes no room): its last range is read without the rest."""
    n = 1_250_000_000
    head = encode_wave(np.zeros(0, np.int16), 48_000, 1)[:40] + struct.pack("<I", 2 * n)
    path = tmp_path / "long.wav"
    with path.open("wb") as f:
        f.write(head)
        f.truncate(44 + 2 * n)
        f.seek(44 + 2 * (n - 3))
        f.write(struct.pack("<3h", 16_384, -16_384, 8_192))
    size = 44 + 2 * n
    assert len(wave_files.split_files([(str(path), size)], 64 << 20)) == 38
    last = list(wave_files.read_range(str(path), size, size - 1_000_000, size, 1 << 16))
    row = last[-1].to_pylist()[0]
    assert row["n_source"] == n and row["first_sample"] == n // (1 << 16) * (1 << 16) and np.frombuffer(row["pcm"], "<f4")[-3:].tolist() == [0.5, -0.5, 0.25]


def test_many_ranges_are_read_together(spark, tmp_path):
    """More ranges than MOST_RANGES go to few tasks, each file opened once by a task, and nothing is read twice or left out."""
    files = [(f"f{i}", 1_000 + 900 * (i % 4)) for i in range(1_000)]
    parts = wave_files.split_files(files, 1_000)
    tasks = wave_files.tasks_of(parts, 256, 100_000)
    assert len(parts) > 1_000 and len(tasks) < 30
    spans = sorted((path, begin, end) for task in tasks for path, _, begin, end in task)
    assert len(spans) < 1_030 and [s for path, size in sorted(files) for s in [(path, 0, size)]] == sorted({(p, min(b for q, b, _ in spans if q == p), max(e for q, _, e in spans if q == p)) for p, _, _ in spans})
    assert all(x[0] != y[0] or x[2] == y[1] for x, y in zip(spans[:-1], spans[1:], strict=True))
    rng = np.random.default_rng(4)
    for i in range(150):
        (tmp_path / f"{i}.wav").write_bytes(encode_wave(rng.integers(-9_000, 9_000, 40 * i).astype(np.int16), 1_000, 1))
    (tmp_path / "none.wav").write_bytes(b"no audio")
    read = wave_files.read_chunks(spark, str(tmp_path), 1_500, 300).withColumn("id", F.element_at(F.split("id", "/"), -1))
    assert read.rdd.getNumPartitions() == 1
    want = samples(ch.chunk_blocks(read, 40))
    once = samples(ch.chunk_blocks(read, 40, one_shape=True))
    assert want.keys() == once.keys() and len(want) == 151 and once["none.wav"] == want["none.wav"] == "unsupported"
    for i in range(150):
        x = np.frombuffer((tmp_path / f"{i}.wav").read_bytes()[44:], "<i2").astype(np.float32) / 32_768
        whole = dsp.resample(x, 1_000)
        for got in (once[f"{i}.wav"], want[f"{i}.wav"]):  # blocks end with the last whole frame
            assert len(whole) - len(got) < 1_024 and (got.view(np.int32) == whole[: len(got)].view(np.int32)).all()


def test_periods_equal_single_outputs():
    """Outputs made by whole periods are those made one by one, bit by bit, at every usual rate and wherever the signal begins."""
    rng = np.random.default_rng(5)
    for rate in (1_000, 8_000, 11_024, 16_000, 22_050, 44_100, 48_000, 96_000, 384_000):
        bank, x = dsp.Resampler(rate), rng.standard_normal(9_000).astype(np.float32)
        for start in (0, 12_345, 99_999_999):
            first = max(0, int((start - 50) / bank.ratio) + 7)
            for n in (100, 4 * min(bank.period, 2_048) + 13, 9_000):
                got, want = bank.outputs(x, start, first, first + n), bank._singly(x, start, np.arange(first, first + n))
                assert (got.view(np.int32) == want.view(np.int32)).all(), (rate, start, n)
