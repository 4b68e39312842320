"""Decoding of one encoded blob: RIFF/WAVE, tagged or not; MPEG audio needs a decoder that the caller supplies."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from echolith.constants import MAX_MP3_BYTES, MAX_MP3_SAMPLES
from echolith.errors import SignalError


@dataclass
class Audio:
    samples: np.ndarray  # interleaved float32
    rate: int
    channels: int


@dataclass
class Layout:
    """Where the samples of a RIFF/WAVE file lie, and what they are."""

    kind: int
    bits: int
    rate: int
    channels: int
    begin: int
    count: int  # samples, of all channels together

    @property
    def width(self) -> int:
        return self.bits // 8


def wave_layout(read: Callable[[int, int], bytes], size: int) -> Layout:
    """The layout of a file of size bytes, of which read(offset, n) gives some: format and data chunks, of several the last; the outer size is not read. Only chunk heads are looked at."""
    head = read(0, 12)
    if len(head) < 12:
        raise SignalError("decode", "truncated RIFF/WAVE header")
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise SignalError("decode", "no WAVE tag found")
    form = data = None
    at = 12
    while at + 8 <= size:
        name, n = struct.unpack("<4sI", read(at, 8))
        begin, end = at + 8, at + 8 + n
        if end > size:
            raise SignalError("decode", "truncated WAV chunk")
        if name == b"fmt ":
            if n < 16:
                raise SignalError("decode", "truncated WAV fmt chunk")
            form = struct.unpack("<HHI6xH", read(begin, 16))
        elif name == b"data":
            data = (begin, end)
        at = end + n % 2
    if form is None:
        raise SignalError("decode", "missing WAV fmt chunk")
    if data is None:
        raise SignalError("decode", "missing WAV data chunk")
    kind, channels, rate, bits = form
    if channels == 0:
        raise SignalError("unsupported", "unsupported WAV channel count: 0")
    if bits == 0 or bits % 8:
        raise SignalError("unsupported", f"Unsupported WAV format: {bits} bit")
    return Layout(kind, bits, rate, channels, data[0], (data[1] - data[0]) // (bits // 8))


def wave_samples(of: Layout, raw: bytes | memoryview) -> np.ndarray:
    """Raw samples as float32."""
    if not len(raw):
        return np.zeros(0, np.float32)  # formats are judged by their first sample only
    if (of.kind, of.bits) == (1, 8):
        return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / np.float32(128)
    if (of.kind, of.bits) == (1, 16):
        return np.frombuffer(raw, "<i2").astype(np.float32) / np.float32(1 << 15)
    if (of.kind, of.bits) == (1, 24):
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / np.float32(1 << 23)
    if (of.kind, of.bits) == (1, 32):
        return np.frombuffer(raw, "<i4").astype(np.float32) / np.float32(1 << 31)
    if (of.kind, of.bits) == (3, 32):
        return np.frombuffer(raw, "<f4").astype(np.float32)
    raise SignalError("unsupported", f"Unsupported WAV format: {of.bits} bit")


def decode_wave(blob: bytes) -> Audio:
    """All samples of a RIFF/WAVE blob."""
    of = wave_layout(lambda at, n: blob[at : at + n], len(blob))
    return Audio(wave_samples(of, memoryview(blob)[of.begin : of.begin + of.count * of.width]), of.rate, of.channels)


def encode_wave(samples: np.ndarray, rate: int, channels: int) -> bytes:
    """A 16-bit RIFF/WAVE blob of interleaved int16 samples."""
    raw = samples.astype("<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(raw), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", len(raw)) + raw


def without_tags(blob: bytes) -> bytes:
    """blob after any ID3v2 tags at its start; empty if one reaches its end."""
    while blob[:3] == b"ID3" and len(blob) >= 10:
        size = 0
        for byte in blob[6:10]:
            size = size << 7 | byte & 0x7F
        footer = 10 if blob[3] >= 4 and blob[5] & 0x10 else 0
        end = 10 + size + footer
        blob = blob[end:] if end < len(blob) else b""
    return blob


def decode(blob: bytes, mpeg: Callable[[bytes], Audio] | None = None) -> Audio:
    """The samples of a blob, or a SignalError. mpeg decodes MPEG audio; without it such blobs are unsupported."""
    if blob[:4] == b"RIFF":
        return decode_wave(blob)
    if not (blob[:3] == b"ID3" or len(blob) >= 2 and blob[0] == 0xFF and blob[1] & 0xE0 == 0xE0):
        raise SignalError("unsupported", "Unsupported audio format.")
    bare = without_tags(blob)
    if bare[:4] == b"RIFF":
        return decode_wave(bare)
    if len(bare) > MAX_MP3_BYTES:
        raise SignalError("invalid", "MP3 input is too large")
    if mpeg is None:
        raise SignalError("unsupported", "Unsupported audio format.")
    audio = mpeg(bare)
    if len(audio.samples) > MAX_MP3_SAMPLES:
        raise SignalError("invalid", "MP3 decodes to too many samples")
    if not len(audio.samples) or not audio.rate or not audio.channels:
        raise SignalError("unsupported", "Unsupported audio format.")
    return audio
