"""Positions in time inside a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SignatureConfig, Timeout


def window_positions(duration: Column, cfg: SignatureConfig) -> Column:
    """array<struct<start,end>> of evenly spaced windows after the skipped part."""
    n = cfg.window_count
    us = F.least(F.lit(float(cfg.skip_secs)), duration * 0.15)
    ue = F.greatest(duration - 0.5, us + 1.0)
    w = F.least(F.lit(float(cfg.window_secs)), ue - us)
    step = (ue - us - w) / float(n - 1) if n > 1 else F.lit(0.0)

    def window(i: Column) -> Column:
        start = us + i.cast("double") * step
        return F.struct(start.alias("start"), F.greatest(F.least(start + w, duration - 0.1), start + 0.5).alias("end"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), window)


def millis(secs: Column) -> Column:
    """Whole milliseconds, towards zero, not under 0; NaN gives 0."""
    return F.when(F.isnan(secs), F.lit(0)).otherwise(F.greatest(secs * 1000.0, F.lit(0.0))).cast("bigint")


def timeout(duration: Column, t: Timeout) -> Column:
    low = max(t.min, 0.0)
    return F.least(F.greatest(duration * t.factor + t.base, F.lit(low)), F.lit(max(t.max, low)))


def thumb_seek(duration: Column) -> Column:
    return F.greatest((duration.cast("float") * F.lit(0.2).cast("float")).cast("float"), F.lit(1.0).cast("float"))
