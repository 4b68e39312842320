"""Hashes of pitch-class frames, as Column expressions over arrays of twelve floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echolith.constants import DELTA_THRESHOLD
from echolith.functions import grid


def _rises(now: Column, before: Column, at: int, classes: int) -> Column:
    """A bit from position at on for each class that rises by more than the threshold."""
    limit = F.lit(DELTA_THRESHOLD).cast("float")
    bits = F.zip_with(F.slice(now, 1, classes), F.slice(before, 1, classes), lambda x, y: (x.cast("float") - y.cast("float")).cast("float") > limit)
    return F.aggregate(F.transform(bits, lambda b, i: F.when(b, F.call_function("shiftleft", F.lit(1).cast("long"), i + at)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def hash_of(f0: Column, f1: Column, f2: Column, f3: Column) -> Column:
    """The 32-bit hash (a long) that begins at frame f0: rises of its three successors and, over the top four bits, the energy of f0."""
    total = F.aggregate(f0, F.lit(0.0).cast("float"), lambda s, x: (s + x.cast("float")).cast("float"))
    # NaN energy counts as none.
    energy = F.when(F.isnan(total), F.lit(0)).otherwise(F.least(F.greatest((total * 4).cast("long"), F.lit(0)), F.lit(15)))
    rises = _rises(f1, f0, 0, 12).bitwiseOR(_rises(f2, f1, 12, 12)).bitwiseOR(_rises(f3, f2, 24, 4))
    return rises.bitwiseXOR(F.call_function("shiftleft", energy.cast("long"), F.lit(28)))


def hashes_of(frames: Column) -> Column:
    """The hashes of a span of frames (array of arrays); empty for fewer than eight."""
    at = lambda i: F.element_at(frames, (i + 1).cast("int"))
    return F.transform(grid.hash_starts(F.size(frames)), lambda i: hash_of(at(i), at(i + 1), at(i + 2), at(i + 3)))
