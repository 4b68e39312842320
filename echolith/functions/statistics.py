"""The statistics that timings are reported by, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def summary(x: Column) -> dict[str, Column]:
    """min, median, mean, 90th percentile, max and population deviation, by name; percentiles interpolate between neighbours."""
    return {"least": F.min(x), "middle": F.percentile(x, 0.5), "mean": F.avg(x), "p90": F.percentile(x, 0.9), "most": F.max(x), "sd": F.stddev_pop(x)}
