"""Names for SQL: sig_to_bytes, sig_from_bytes, sig_similarity and sig_similarity_drift as functions, decode_audio, sig_windows and sig_top_matches as table functions.

decode_audio and sig_windows get one blob a row (with LATERAL, those of a table) and works on it whole, in the task that holds it; DataFrames have signatures.decoded_blocks() and windowed(), which spread long signals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from echolith.constants import FRAME_SIZE, HOP_SIZE
from echolith.errors import SignalError
from echolith.functions import dsp, scoring
from echolith.operators import matcher
from echolith.sources.wave import decode
from echolith.streaming.signal import ms_for_samples

__all__ = ["register", "sig_to_bytes", "sig_from_bytes", "sig_similarity", "sig_similarity_drift", "DecodeAudio", "SigWindows", "SigTopMatches"]

_SIGNATURE = T.StructType([T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("duration_ms", T.LongType())])


@F.pandas_udf(T.BinaryType())
def sig_to_bytes(hashes: pd.Series, duration_ms: pd.Series) -> pd.Series:
    """The binary form of a hash sequence and its duration; null if either is."""
    one = lambda h, ms: None if h is None or pd.isna(ms) else np.concatenate([[int(ms), len(h)], h]).astype(np.int64).astype("<u4").tobytes()
    return pd.Series([one(h, ms) for h, ms in zip(hashes, duration_ms, strict=True)], dtype=object)


@F.pandas_udf(_SIGNATURE)
def sig_from_bytes(payload: pd.Series) -> pd.DataFrame:
    """hashes and duration_ms of a binary form; nulls for one that is cut short. Bytes after the last hash are ignored."""
    rows = []
    for p in payload:
        head = np.frombuffer(p[:8], "<u4") if p is not None and len(p) >= 8 else None
        whole = head is not None and len(p) >= 8 + 4 * int(head[1])
        rows.append((np.frombuffer(p[8 : 8 + 4 * int(head[1])], "<u4").astype(np.int64), int(head[0])) if whole else (None, None))
    return pd.DataFrame(rows, columns=["hashes", "duration_ms"])


def _scores(a: pd.Series, b: pd.Series, drift: pd.Series) -> pd.Series:
    return scoring.compare_columns(a, b, drift)["score"].astype("float32")


@F.pandas_udf(T.FloatType())
def sig_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of matching bits at offset 0."""
    return _scores(a, b, pd.Series(0, index=a.index))


@F.pandas_udf(T.FloatType())
def sig_similarity_drift(a: pd.Series, b: pd.Series, max_drift: pd.Series) -> pd.Series:
    """The best share of matching bits over offsets up to max_drift."""
    return _scores(a, b, max_drift)


def _signal(content: bytes | None) -> np.ndarray:
    audio = decode(content or b"")
    dsp.check_shape(audio.rate, audio.channels)
    return dsp.resample(dsp.downmix(audio.samples, audio.channels), audio.rate)


class DecodeAudio:
    """n_samples, samples (mono at the target rate), code and message: one row for a blob."""

    schema = "n_samples long, samples array<float>, code string, message string"

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            mono = _signal(content)
            yield len(mono), mono.tolist(), None, None
        except SignalError as e:
            yield None, None, e.code, e.message


class SigWindows:
    """window_idx, timestamp_ms, duration_ms, hashes, code and message: a row for each complete window of a blob, or one with its error; null arguments count as 0."""

    schema = "window_idx long, timestamp_ms long, duration_ms long, hashes array<long>, code string, message string"

    def eval(self, content: bytes, window_ms: int, interval_ms: int) -> Iterator[tuple]:
        try:
            mono = _signal(content)
            length, step = dsp.window_samples(window_ms, interval_ms)
            hashes = dsp.frame_hashes(dsp.chroma(mono))
            for k, start in enumerate(range(0, len(mono) - length + 1, step)):
                first, last = -(-start // HOP_SIZE), (start + length - FRAME_SIZE) // HOP_SIZE
                yield k, ms_for_samples(start), window_ms, hashes[first + dsp.span_starts(max(0, last - first + 1))].tolist(), None, None
        except SignalError as e:
            yield None, None, None, None, e.code, e.message


class SigTopMatches:
    """query_id, ckpt_seq, timestamp, order_key, score, best_offset: the k best checkpoints of each query within a pack.

    The argument TABLE(...) has the columns pack, query_id, ckpt_seq, timestamp and hashes: a query's row has no ckpt_seq and
    stands in every pack, a checkpoint's has one and stands in a pack of the caller's choice. It is partitioned by pack, queries first. A task holds
    a pack's queries and k checkpoints for each, and streams the checkpoints past them in blocks. Packs are merged by the rank
    over query_id of score (falling), order_key (the total order of timestamps) and ckpt_seq. Sequences that are null or hold anything but unsigned 32-bit words take no part.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, k: AnalyzeArgument, max_drift: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("sig_top_matches: the first argument is a TABLE(...)")
        lacks = [c for c in ("pack", "query_id", "ckpt_seq", "timestamp", "hashes") if c not in table.dataType.names]
        if lacks:
            raise ValueError(f"sig_top_matches: the table has no column {', '.join(lacks)}")
        if not (k.isConstantExpression and isinstance(k.value, int) and k.value >= 1):
            raise ValueError("sig_top_matches: k is a constant of 1 or more")
        if not (max_drift.isConstantExpression and isinstance(max_drift.value, int)):
            raise ValueError("sig_top_matches: max_drift is a constant")
        schema = T.StructType([T.StructField("query_id", table.dataType["query_id"].dataType)])
        schema.add("ckpt_seq", T.LongType()).add("timestamp", T.FloatType()).add("order_key", T.IntegerType()).add("score", T.FloatType()).add("best_offset", T.IntegerType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("pack")], orderBy=[OrderingColumn("ckpt_seq", True, overrideNullsFirst=True)])

    def __init__(self):
        self.ids, self.queries, self.flat = [], [], None
        self.block, self.n = [], 0
        self.best = [np.zeros(0, t) for t in (np.int64, np.int64, np.float32, np.int32, np.float32, np.int32)]
        self.k = self.drift = 0

    def eval(self, row: Row, k: int, max_drift: int) -> None:
        self.k, self.drift = k, max(0, max_drift)
        hashes = row["hashes"]
        if hashes is None or not all(h is not None and 0 <= h < 1 << 32 for h in hashes):
            return
        if row["ckpt_seq"] is None:
            self.ids.append(row["query_id"])
            self.queries.append(np.array(hashes, np.int64))
            return
        timestamp = row["timestamp"]
        self.block.append((row["ckpt_seq"], np.nan if timestamp is None else timestamp, np.array(hashes, np.int64)))
        self.n += len(hashes) + 1
        if self.n >= matcher.PACK_HASHES:
            self._compare()

    def _compare(self) -> None:
        if not (self.block and self.ids):
            return
        flatten = lambda x: (np.concatenate(x), np.array([len(h) for h in x], np.int32))
        if self.flat is None:
            self.flat = flatten(self.queries)
        seq, stamps = np.array([b[0] for b in self.block], np.int64), np.array([b[1] for b in self.block], np.float32)
        keys = matcher.total_order(stamps)
        order = np.empty(len(seq), np.int64)
        order[np.lexsort((seq, keys))] = np.arange(len(seq))
        found = [self.best]
        put = lambda i, c, s, o: found.append([np.full(len(c), i), seq[c], stamps[c], keys[c], s, o])
        matcher.compare_all(*self.flat, *flatten([b[2] for b in self.block]), self.drift, self.k, order, put)
        i, c, t, key, s, o = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((c, key, -s, i))
        by = by[np.arange(len(by)) - np.searchsorted(i[by], i[by]) < self.k]
        self.best = [x[by] for x in (i, c, t, key, s, o)]
        self.block, self.n = [], 0

    def terminate(self) -> Iterator[tuple]:
        self._compare()
        for i, c, t, key, s, o in zip(*(x.tolist() for x in self.best), strict=True):
            yield self.ids[i], c, t, key, s, o


def register(spark: SparkSession) -> None:
    """Make the names known to the session's SQL."""
    for f in (sig_to_bytes, sig_from_bytes, sig_similarity, sig_similarity_drift):
        spark.udf.register(f.__name__, f)
    for name, c in (("decode_audio", DecodeAudio), ("sig_windows", SigWindows)):
        spark.udtf.register(name, F.udtf(c, returnType=c.schema))
    spark.udtf.register("sig_top_matches", F.udtf(SigTopMatches))
