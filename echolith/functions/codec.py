"""The binary form of a hash sequence: duration, count and hashes as little-endian 32-bit words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _word(x: Column) -> Column:
    """A non-negative long below 2**32 as eight hex digits, low byte first."""
    byte = lambda k: F.lpad(F.hex(F.shiftright(x, 8 * k).bitwiseAND(F.lit(255))), 2, "0")
    return F.concat(byte(0), byte(1), byte(2), byte(3))


def to_bytes(hashes: Column, duration_ms: Column) -> Column:
    """8 + 4 n bytes; null if hashes or duration is null."""
    head = F.concat(_word(duration_ms.cast("long")), _word(F.size(hashes).cast("long")))
    return F.when(hashes.isNotNull(), F.unhex(F.concat(head, F.array_join(F.transform(hashes, lambda h: _word(h.cast("long"))), ""))))


def _read(digits: Column, at: Column | int) -> Column:
    """The little-endian word at a byte offset of a hex string."""
    at = at if isinstance(at, Column) else F.lit(at)
    pick = lambda k: F.substring(digits, (2 * (at + k) + 1).cast("int"), F.lit(2))
    return F.conv(F.concat(pick(3), pick(2), pick(1), pick(0)), 16, 10).cast("long")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _words(payload: pd.Series) -> pd.Series:
    """The little-endian words of a payload; none of a null one."""
    return payload.map(lambda p: None if p is None else np.frombuffer(p, "<u4").astype(np.int64))


def from_bytes(payload: Column) -> Column:
    """(hashes, duration_ms); null for fewer than eight bytes or fewer hashes than counted. Bytes after the last hash are ignored."""
    size, head = F.octet_length(payload).cast("long"), F.hex(F.substring(payload, F.lit(1), F.lit(8)))
    count = _read(head, 4)
    whole = F.coalesce((size >= 8) & (size >= 8 + 4 * count), F.lit(False))
    body = F.when(whole, F.substring(payload, F.lit(9), (4 * count).cast("int")))
    return F.when(whole, F.struct(_words(body).alias("hashes"), _read(head, 0).alias("duration_ms")))
