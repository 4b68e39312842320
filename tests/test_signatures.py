"""Kernels and operators against known values."""

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echolith.errors import SignalError
from echolith.functions import codec, dsp, hashing, scoring
from echolith.operators import signatures as ops
from echolith.operators.matcher import Matcher
from echolith.sources import files
from echolith.sources.wave import decode, decode_wave, encode_wave, without_tags

# The format's published results for the signal of tone().
WHOLE = "907003f0 8c817c00 9001800c 601e0030 70300100 71c01600 66003001 5800c016 50018008 50020030 500d0040 600800d0"
WINDOWS = ["907003f0 8c817c00 9001800c 70030018", "601e0030 70300100 71c01600", "63001c01 6c016003 7800800c", "60030018 60040020 600800d0", "60110080 60200100 50400400", "50c00400 51000800 42003001 52002003", "50002002 50004000 58008000", "40008008 50010010 50020010"]


def tone(seconds, rate=11025):
    t = np.arange(int(seconds * rate), dtype=np.float32) / np.float32(rate)
    wave = lambda x: np.sin((np.float32(2 * np.pi) * x).astype(np.float32))
    swell = np.float32(0.6) + np.float32(0.4) * wave(np.float32(3) * t)
    return (np.float32(0.4) * swell * (wave((np.float32(200) + np.float32(300) * t) * t) + np.float32(0.5) * wave(np.float32(660) * t))).astype(np.float32)


def agreement(found, want):
    want = [int(x, 16) for x in want.split()]
    assert len(found) == len(want)
    return 1 - sum((a ^ b).bit_count() for a, b in zip(found, want, strict=True)) / (32 * len(want))


def blob(kind, bits, channels, rate, data):
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits, b"data", len(data)) + data


def test_whole_signal_and_windows(spark):
    rows = spark.createDataFrame([("a", tone(3).tolist()), ("b", tone(5).tolist()), ("short", [0.0] * 10), ("none", None)], "id string, samples array<float>")
    for block in (3, 2048):
        blocks = ops.sample_blocks(rows, block)
        whole = {r.id: r for r in ops.signatures(blocks).collect()}
        assert agreement(whole["a"].hashes, WHOLE) >= 0.99 and whole["a"].duration_ms == 3000
        assert whole["short"].hashes == [] and whole["none"].hashes == []
        found = sorted((r.window_idx, r.timestamp_ms, r.hashes) for r in ops.windowed(blocks, 1500, 500).filter("id = 'b'").collect())
        assert [x[1] for x in found] == [500 * i for i in range(8)]
        assert all(agreement(x[2], w) >= 0.99 for x, w in zip(found, WINDOWS, strict=True))


def test_decoded_stereo_and_errors(spark):
    stereo = np.repeat((tone(2, 44100) * 32767).astype(np.int16), 2)
    blobs = spark.createDataFrame([("w", encode_wave(stereo, 44100, 2)), ("junk", b"abc"), ("cut", b"RIFF\x04\0\0\0WAV"), ("mp3", b"\xff\xfb\x90\x64" + bytes(4096)), ("rate", blob(1, 16, 1, 400_000, bytes(8))), ("null", None)], "id string, content binary")
    found = {(r.id, r.window_idx): r for r in ops.windowed(ops.decoded_blocks(blobs), 1500, 500).collect()}
    assert [agreement(found["w", i].hashes, WINDOWS[i]) >= 0.99 for i in (0, 1)] == [True, True]
    codes = {k[0]: r.error.code for k, r in found.items() if r.error}
    assert codes == {"junk": "unsupported", "cut": "decode", "mp3": "unsupported", "rate": "invalid", "null": "unsupported"}
    bad = ops.windowed(ops.decoded_blocks(blobs), 1, 500).filter("id = 'w'").first()
    assert bad.error.message == "Window too short: 11 samples, need at least 4096"


def test_sql_hashes_equal_the_kernel(spark):
    blocks = ops.sample_blocks(spark.createDataFrame([("a", tone(3).tolist())], "id string, samples array<float>"), 7)
    frames = ops.frames_of(blocks, 7).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("frame_idx", "chroma"))).alias("x"))
    got = frames.select(hashing.hashes_of(F.transform("x", lambda x: x["chroma"])).alias("h")).first().h
    assert got == ops.signatures(blocks).first().hashes


@pytest.mark.parametrize(
    "kind, bits, data, want",
    [
        (1, 8, bytes([0, 128, 255]), [-1.0, 0.0, 127 / 128]),
        (1, 16, struct.pack("<4h", -32768, 0, 16384, 32767), [-1.0, 0.0, 0.5, 32767 / 32768]),
        (1, 24, b"\x00\x00\x80\x00\x00\x00\xff\xff\x7f", [-1.0, 0.0, 8388607 / 8388608]),
        (1, 32, struct.pack("<3i", -(2**31), 0, 2**30), [-1.0, 0.0, 0.5]),
        (3, 32, struct.pack("<2f", -0.25, 0.5), [-0.25, 0.5]),
        (2, 16, b"", []),
    ],
)
def test_wave_depths(kind, bits, data, want):
    audio = decode_wave(blob(kind, bits, 1, 8000, data))
    assert audio.samples.tolist() == pytest.approx(want, abs=1e-7) and audio.rate == 8000


@pytest.mark.parametrize("bad, code", [(b"", "unsupported"), (b"RIFF", "decode"), (blob(1, 12, 1, 8000, bytes(8)), "unsupported"), (blob(2, 16, 1, 8000, bytes(8)), "unsupported"), (blob(1, 16, 0, 8000, b""), "unsupported"), (blob(1, 16, 1, 8000, bytes(8))[:-1], "decode"), (b"RIFF\0\0\0\0WAVE", "decode")])
def test_wave_errors(bad, code):
    with pytest.raises(SignalError) as e:
        decode(bad)
    assert e.value.code == code and SignalError.from_status(e.value.status, "x").code == code


def test_tags_are_skipped():
    plain = blob(1, 16, 1, 8000, struct.pack("<2h", 1, 2))
    tag = b"ID3\x03\0\0\0\0\0\x10" + bytes(16)
    footed = b"ID3\x04\0\x10\0\0\0\x02" + bytes(2) + bytes(10)
    assert decode(tag + footed + plain).samples.tolist() == decode(plain).samples.tolist()
    assert without_tags(b"ID3\x03\0\x10\0\0\0\x02" + bytes(2) + b"x") == b"x" and without_tags(tag) == b""


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=200), st.sampled_from([b"", b"RIFF", b"ID3\x04\0\0", b"\xff\xfb", blob(1, 16, 1, 8000, b"")[:40]]))
def test_junk_never_fails_otherwise(junk, head):
    try:
        decode(head + junk)
    except SignalError:
        pass


def test_resampler():
    assert dsp.downmix(np.array([1, -1, 0.5, 0.25, -0.5, 0.5], np.float32), 2).tolist() == [0, 0.375, 0]
    for n, rate, want in ((44101, 44100, 11025), (48000, 48000, 11024), (7, 22050, 3)):
        assert len(dsp.resample(np.zeros(n, np.float32), rate)) == want
    at = np.arange(44100) / 44100
    keep, alias = (dsp.resample(np.sin(2 * np.pi * hz * at).astype(np.float32), 44100)[500:-500] for hz in (440, 7000))
    assert 0.97 <= np.abs(keep).max() <= 1.03 and np.abs(alias).max() < 0.02


BASE = [(i * 2654435761) % 2**32 for i in range(64)]


@pytest.mark.parametrize(
    "a, b, drift, score, offset, count, bits",
    [
        ([0, 2**32 - 1], [0, 2**32 - 1], 0, 1.0, 0, 2, 64), ([0], [2**32 - 1], 0, 0.0, 0, 1, 0), ([], [1, 2], 3, 0.0, 0, 0, 0), ([1, 2, 3], [9, 1, 2, 3], 1, 1.0, -1, 3, 96),
        ([0xDEADBEEF] * 3 + BASE, BASE, 8, 1.0, 3, 64, 2048), (BASE, [0xDEADBEEF] * 7 + BASE, 8, 1.0, -7, 64, 2048), ([0x0F0F0F0F] * 8, [0x0F0F0F0F] * 8, 3, 1.0, 0, 8, 256),
    ],
)
def test_drift(spark, a, b, drift, score, offset, count, bits):
    row = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(F.inline(F.array(scoring.drift_comparison(F.col("a"), F.col("b"), drift)))).first()
    assert tuple(row) == (score, offset, count, bits)


def test_codec(spark):
    payload = bytes.fromhex("D20400000200000044332211DDCCBBAA")
    rows = [([0x11223344, 0xAABBCCDD], 1234, payload), ([], 0, bytes(8)), (None, None, bytes.fromhex("010203")), (None, None, bytes.fromhex("000000000200000001000000")), (None, None, None), ([1], 2**32 - 1, b"\xff\xff\xff\xff\x01\0\0\0\x01\0\0\0")]
    df = spark.createDataFrame(rows, "hashes array<long>, ms long, payload binary")
    for r in df.select("hashes", "ms", "payload", codec.to_bytes(F.col("hashes"), F.col("ms")).alias("packed"), codec.from_bytes(F.col("payload")).alias("read"), codec.from_bytes(F.concat("payload", F.unhex(F.lit("090909")))).alias("more")).collect():
        assert r.packed == (r.payload if r.hashes is not None else None)
        assert (r.read and (r.read.hashes, r.read.duration_ms)) == ((r.hashes, r.ms) if r.hashes is not None else None)
        if r.hashes is not None:
            assert r.more == r.read


def test_matcher(spark, tmp_path):
    stored = spark.createDataFrame([(0, 20.0, 3.0, [0, 1, 2]), (1, 10.0, 4.0, [7, 0, 1, 2]), (2, 30.0, 5.0, [0, 1, 2])], "ckpt_seq long, timestamp float, duration float, hashes array<long>")
    queries = spark.createDataFrame([("q", [0, 1, 2]), ("empty", [])], "query_id string, hashes array<long>")
    m = Matcher(stored.limit(0)).add(stored).with_drift(1)
    assert m.count().first().n == 3 and m.clear().count().first().n == 0
    assert [tuple(r)[1:4] for r in m.top(queries, 2).filter("query_id = 'q'").orderBy("rank").collect()] == [(1, 10.0, 1.0), (2, 20.0, 1.0)]
    assert m.top(queries, 0).count() == 0 and m.top(queries, 9).count() == 6
    files.write_signatures(stored.select("ckpt_seq", "hashes", F.lit(5).alias("duration_ms")), str(tmp_path / "s"))
    assert sorted(r.hashes for r in files.read_signatures(spark, str(tmp_path / "s")).collect()) == sorted(r.hashes for r in stored.collect())


def test_matcher_in_blocks(spark, monkeypatch):
    from echolith.operators import matcher

    rows = [(i, float(64 - i), 1.0, [h ^ (i * 2654435761 % 2**32) for h in range(16)]) for i in range(64)]
    stored = spark.createDataFrame(rows, "ckpt_seq long, timestamp float, duration float, hashes array<long>")
    q = stored.filter("ckpt_seq in (3, 40)").select(F.col("ckpt_seq").alias("query_id"), "hashes")
    m = Matcher(stored, 2)
    whole = [tuple(r) for r in m.top(q, 33).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(matcher, "BROADCAST_HASHES", 16)
    monkeypatch.setattr(matcher, "PACK_HASHES", 100)
    assert [tuple(r) for r in m.top(q, 33).orderBy("query_id", "rank").collect()] == whole
    assert [tuple(r) for r in m.top(q, 5).orderBy("query_id", "rank").collect()] == [r for r in whole if r[1] <= 5]


def test_sql_names(spark):
    """Every public name of the SQL module is registered, and the table functions give what the DataFrame operators give."""
    from echolith import sql
    from echolith.sources.wave import encode_wave

    assert set(sql.__all__) == {"register", "sig_to_bytes", "sig_from_bytes", "sig_similarity", "sig_similarity_drift", "DecodeAudio", "SigWindows", "SigTopMatches"} and all(hasattr(sql, n) for n in sql.__all__)
    sql.register(spark)
    rng = np.random.default_rng(3)
    blobs = spark.createDataFrame([("a", encode_wave((rng.standard_normal(60_000) * 3000).astype(np.int16), 8_000, 2)), ("b", b"RIFF"), ("c", b"")], "id string, content binary")
    blobs.createOrReplaceTempView("blobs")
    got = spark.sql("SELECT id, w.* FROM blobs, LATERAL sig_windows(content, 1500, 500) w").collect()
    want = ops.windowed(ops.decoded_blocks(blobs), 1_500, 500).collect()
    key = lambda r, code: (r.id, r.window_idx if r.window_idx is not None else -1, r.timestamp_ms, r.duration_ms, r.hashes, code)
    assert sorted((key(r, r.code) for r in got), key=repr) == sorted((key(r, r.error and r.error.code) for r in want), key=repr) and len(got) > 4
    sizes = {r.id: r.n_samples for r in spark.sql("SELECT id, d.n_samples FROM blobs, LATERAL decode_audio(content) d").collect()}
    assert sizes["a"] == int(30_000 / (8_000 / 11_025)) and sizes["b"] is None
