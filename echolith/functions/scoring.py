"""Agreement of hash sequences: matching bits over the positions that two sequences share, at one offset or the best of several."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def words_sound(words: Column) -> Column:
    """Whether all of a sequence are unsigned 32-bit words; false for null, and for a null among them."""
    return F.coalesce(F.forall(words, lambda w: F.coalesce(w.between(0, (1 << 32) - 1), F.lit(False))), F.lit(False))


def _score(bits: Column, count: Column) -> Column:
    """bits / (32 count) rounded once to float; 0 without a shared position."""
    ratio = F.when(count < 524_288, (bits.cast("double") / (count * 32)).cast("float")).otherwise((bits.cast("float") / (count * 32).cast("float")).cast("float"))
    return F.when(count == 0, F.lit(0.0).cast("float")).otherwise(ratio)


def at_offset(a: Column, b: Column, offset: Column | int) -> Column:
    """(score, best_offset, compared_hashes, matching_bits) with offset leading hashes of a left out (of b, if negative); null if a sequence is null or holds anything but unsigned 32-bit words."""
    offset = (offset if isinstance(offset, Column) else F.lit(offset)).cast("int")
    skip_a, skip_b = F.greatest(offset, F.lit(0)), F.greatest(-offset, F.lit(0))
    count = F.greatest(F.least(F.size(a) - skip_a, F.size(b) - skip_b), F.lit(0))
    agreed = F.zip_with(F.slice(a, skip_a + 1, count), F.slice(b, skip_b + 1, count), lambda x, y: F.lit(32) - F.bit_count(x.bitwiseXOR(y)))
    bits = F.aggregate(agreed, F.lit(0).cast("long"), lambda s, x: s + x)
    found = F.struct(_score(bits, count).alias("score"), offset.alias("best_offset"), count.cast("long").alias("compared_hashes"), bits.alias("matching_bits"))
    return F.when(words_sound(a) & words_sound(b), found)


def similarity(a: Column, b: Column) -> Column:
    """The score at offset 0 over the shorter length."""
    return at_offset(a, b, 0)["score"]


def offsets(limit: int) -> list[int]:
    """0, +1, -1, ... up to limit: the order in which they are tried."""
    return [0, *(o for k in range(1, limit + 1) for o in (k, -k))]


def scores_of(bits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """bits / (32 counts) rounded once to float32; 0 without a shared position."""
    safe = np.maximum(counts, 1)
    exact = (bits / (safe * 32.0)).astype(np.float32)
    large = bits.astype(np.float32) / (safe * 32).astype(np.float32)
    return np.where(counts == 0, np.float32(0), np.where(counts < 524_288, exact, large)).astype(np.float32)


def compare_flat(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, ...]:
    """(score, best_offset, compared_hashes, matching_bits) of pairs whose sequences stand one after another in a and b. All pairs are tried at an offset at once."""
    limit = np.minimum(np.minimum(a_sizes, b_sizes), np.maximum(drift, 0))
    a_starts, b_starts = np.cumsum(a_sizes) - a_sizes, np.cumsum(b_sizes) - b_sizes
    n = len(a_sizes)
    best = [np.full(n, -1, np.float32), np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)]
    for o in offsets(int(limit.max(initial=0))):
        some = np.flatnonzero(limit >= abs(o))
        skip_a, skip_b = max(o, 0), max(-o, 0)
        counts = np.maximum(np.minimum(a_sizes[some] - skip_a, b_sizes[some] - skip_b), 0)
        ends = np.cumsum(counts)
        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
        agreed = 32 - np.bitwise_count(a[np.repeat(a_starts[some] + skip_a, counts) + within] ^ b[np.repeat(b_starts[some] + skip_b, counts) + within]).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(agreed)])
        bits = total[ends] - total[ends - counts]
        score = scores_of(bits, counts)
        better = score > best[0][some]
        for kept, new in zip(best, (score, np.full(len(some), o, np.int32), counts, bits), strict=True):
            kept[some[better]] = new[better]
    return tuple(best)


def flat(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a batch's sequences one after another, and the sequences' lengths."""
    sizes = column.map(len).to_numpy(np.int64) if len(column) else np.zeros(0, np.int64)
    return np.concatenate([np.zeros(0, np.int64), *column]).astype(np.int64), sizes


#: Pairs of a batch are compared with so many hashes together (or one longer pair) at a time: some 40 bytes each while they are.
CUT_HASHES = 1 << 20


def compare_columns(a: pd.Series, b: pd.Series, drift: pd.Series) -> pd.DataFrame:
    """score, best_offset, compared_hashes and matching_bits of a batch of pairs; null where a part is null or a sequence holds anything but unsigned 32-bit words."""
    sound = lambda h: h is not None and (len(h) == 0 or bool(((np.asarray(h, np.float64) >= 0) & (np.asarray(h, np.float64) < 1 << 32)).all()))
    there = np.flatnonzero(a.map(sound).to_numpy(bool) & b.map(sound).to_numpy(bool) & drift.notna().to_numpy())
    ends = np.cumsum([len(a.iloc[i]) + len(b.iloc[i]) for i in there])
    found, at = [], 0
    while at < len(there):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CUT_HASHES, "right")))
        rows = there[at:end]
        cut = compare_flat(*flat(a.iloc[rows]), *flat(b.iloc[rows]), drift.iloc[rows].to_numpy(np.int64))
        found.append(pd.DataFrame(dict(zip(_COMPARISON.names, cut, strict=True)), index=a.index[rows]))
        at = end
    return pd.concat(found).reindex(a.index) if found else pd.DataFrame(index=a.index, columns=_COMPARISON.names, dtype=float)


_COMPARISON = T.StructType([T.StructField("score", T.FloatType()), T.StructField("best_offset", T.IntegerType()), T.StructField("compared_hashes", T.LongType()), T.StructField("matching_bits", T.LongType())])


@F.pandas_udf(_COMPARISON)
def _compared(a: pd.Series, b: pd.Series, drift: pd.Series) -> pd.DataFrame:
    return compare_columns(a, b, drift)


def drift_comparison(a: Column, b: Column, max_drift: Column | int) -> Column:
    """The best comparison over offsets 0, +1, -1, ... up to max_drift and both lengths; of equal scores the earliest offset counts. Without hashes on either side all is 0; all is null for a null sequence or one that holds anything but unsigned 32-bit words."""
    drift = (max_drift if isinstance(max_drift, Column) else F.lit(max_drift)).cast("int")
    return _compared(a, b, drift)


def drift_similarity(a: Column, b: Column, max_drift: Column | int) -> Column:
    return drift_comparison(a, b, max_drift)["score"]
