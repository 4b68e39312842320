"""RIFF/WAVE files as a Spark data source of PCM chunks, which reads one file in many tasks.

A partition is a range of bytes, or several small files; where these are many, several of them together. Its task reads the few bytes of the file's head, and then the chunks that begin in its range, one after another; so a file may be larger than any memory. Files are
reached through pyarrow's file systems: local paths and the URIs that these know (file, hdfs, s3, gs).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from echolith.errors import SignalError
from echolith.functions import dsp
from echolith.sources.wave import Layout, wave_layout, wave_samples

#: id is the file's path; chunk_seq and first_sample count whole frames of all channels; pcm holds interleaved little-endian 32-bit floats. A file that cannot be read has one row, with its error.
SCHEMA = "id string, chunk_seq long, first_sample long, n_source long, format string, sample_rate long, channels int, pcm binary, error struct<code:string,message:string>"
SPLIT_BYTES, CHUNK_SAMPLES = 64 << 20, 1 << 16
#: More ranges than MOST_RANGES are read several in a task, up to TASK_BYTES together.
MOST_RANGES, TASK_BYTES = 256, 4 << 20
#: Rows are put out together up to so many bytes of PCM; a file's head is read in one piece of so many bytes.
BATCH_BYTES, HEAD_BYTES = 1 << 20, 4_096


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if urlsplit(path).scheme else (pafs.LocalFileSystem(), path)


@dataclass
class Ranges(InputPartition):
    """(path, size, first byte, end) of the ranges that one task reads."""

    parts: list[tuple[str, int, int, int]]

    def __init__(self, parts):
        super().__init__(None)
        self.parts = parts


def split_files(files: list[tuple[str, int]], split_bytes: int) -> list[list[tuple[str, int, int, int]]]:
    """Large files cut into ranges, small ones put together, up to split_bytes each."""
    out, held, n = [], [], 0
    for path, size in files:
        if size >= split_bytes:
            out += [[(path, size, at, min(size, at + split_bytes))] for at in range(0, size, split_bytes)]
            continue
        if held and n + size > split_bytes:
            out.append(held)
            held, n = [], 0
        held.append((path, size, 0, max(1, size)))
        n += size
    return [*out, held] if held else out


def tasks_of(parts: list[list[tuple[str, int, int, int]]], most: int = MOST_RANGES, task_bytes: int = TASK_BYTES) -> list[list[tuple[str, int, int, int]]]:
    """What each task reads: a part each, or if they are more than most, parts together up to task_bytes. Ranges of a file that follow each other become one, so it is opened once."""
    if len(parts) <= most:
        return parts
    out, n = [], task_bytes
    for part in parts:
        more = sum(end - begin for _, _, begin, end in part)
        if n + more > task_bytes:
            out.append([])
            n = 0
        n += more
        for path, size, begin, end in part:
            if out[-1] and out[-1][-1][0] == path and out[-1][-1][3] == begin:
                begin = out[-1].pop()[2]
            out[-1].append((path, size, begin, end))
    return out


def _untagged(file, size: int) -> int:
    """Where the file's content begins: behind its ID3v2 tags, at its end if one reaches that."""
    at = 0
    while True:
        head = file.read_at(min(10, size - at), at) if at < size else b""
        if len(head) < 10 or head[:3] != b"ID3":
            return at
        length = 0
        for byte in head[6:10]:
            length = length << 7 | byte & 0x7F
        at = min(size, at + 10 + length + (10 if head[3] >= 4 and head[5] & 0x10 else 0))


def _row(path: str, of: Layout | None = None, chunk: int | None = None, first: int | None = None, pcm: bytes | None = None, error: SignalError | None = None) -> tuple:
    return path, chunk, first, of and of.count // of.channels, "f32" if of else None, of and of.rate, of and of.channels, pcm, error and {"code": error.code, "message": error.message}


_TYPES = dict(id=pa.string(), chunk_seq=pa.int64(), first_sample=pa.int64(), n_source=pa.int64(), format=pa.string(), sample_rate=pa.int64(), channels=pa.int32(), pcm=pa.binary(), error=pa.struct([("code", pa.string()), ("message", pa.string())]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES.values(), strict=True)], names=list(_TYPES))


class _Headed:
    """A file of which the first bytes are read once, and the small reads in them served from there."""

    def __init__(self, file, size: int):
        self.file, self.head = file, file.read_at(min(HEAD_BYTES, size), 0)

    def read_at(self, n: int, at: int) -> bytes:
        return self.head[at : at + n] if at + n <= len(self.head) else self.file.read_at(n, at)


def _rows(path: str, size: int, begin: int, end: int, chunk_samples: int) -> Iterator[tuple]:
    system, inner = file_system(path)
    with system.open_input_file(inner) as opened:
        file = _Headed(opened, size)
        try:
            base = _untagged(file, size)
            if base and file.read_at(4, base) != b"RIFF":
                raise SignalError("unsupported", "Unsupported audio format.")
            if not base and file.read_at(min(4, size), 0) != b"RIFF":
                raise SignalError("unsupported", "Unsupported audio format.")
            of = wave_layout(lambda at, n: file.read_at(max(0, min(n, size - base - at)), base + at), size - base)
            dsp.check_shape(of.rate, of.channels)
            wave_samples(of, file.read_at(of.width if of.count else 0, base + of.begin))
        except SignalError as e:
            if begin == 0:
                yield _row(path, error=e)
            return
        n, width = of.count // of.channels, of.width * of.channels
        first_byte, step = base + of.begin, chunk_samples * width
        if not n:
            if begin == 0:
                yield _row(path, of, 0, 0, b"")
            return
        # A chunk belongs to the range that holds its first byte; the range at the file's start also has what would begin before it.
        k = 0 if begin == 0 else max(0, -(-(begin - first_byte) // step))
        while k * chunk_samples < n and first_byte + k * step < end:
            count = min(chunk_samples, n - k * chunk_samples)
            yield _row(path, of, k, k * chunk_samples, wave_samples(of, file.read_at(count * width, first_byte + k * step)).astype("<f4").tobytes())
            k += 1


def read_range(path: str, size: int, begin: int, end: int, chunk_samples: int) -> Iterator[pa.RecordBatch]:
    """The chunks that begin in a range of bytes; the range at a file's start has its error, or the one empty chunk of a file without samples."""
    for row in _rows(path, size, begin, end, chunk_samples):
        yield _batch([row])


class WaveReader(DataSourceReader):
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("load() needs a path")
        self.path = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.chunk = int(options.get("chunksamples", CHUNK_SAMPLES))

    def partitions(self) -> list[Ranges]:
        system, inner = file_system(self.path)
        info = system.get_file_info(inner)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [f for f in system.get_file_info(pafs.FileSelector(inner, recursive=True)) if f.is_file and not f.base_name.startswith((".", "_"))]
        root = self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else ""
        return [Ranges(p) for p in tasks_of(split_files(sorted((root + f.path, f.size) for f in found), self.split))]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for path, size, begin, end in partition.parts:
            for row in _rows(path, size, begin, end, self.chunk):
                held.append(row)
                n += len(row[7] or b"") + 100
                if n >= BATCH_BYTES:
                    yield _batch(held)
                    held, n = [], 0
        if held:
            yield _batch(held)


class WaveSource(DataSource):
    """spark.read.format("wave_chunks").load(path): options splitBytes and chunkSamples."""

    @classmethod
    def name(cls) -> str:
        return "wave_chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WaveReader:
        return WaveReader({k.lower(): v for k, v in self.options.items()})


def read_chunks(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, chunk_samples: int = CHUNK_SAMPLES):
    """The chunks of a file, or of all files below a folder (hidden ones not)."""
    spark.dataSource.register(WaveSource)
    return spark.read.format("wave_chunks").option("splitBytes", split_bytes).option("chunkSamples", chunk_samples).load(path)
