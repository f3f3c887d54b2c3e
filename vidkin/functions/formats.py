"""Display formats of durations, bit rates, sizes and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tenths(top: Column, unit: int) -> Column:
    """top/unit with one decimal, half to even, in exact integer arithmetic."""
    t = top * 10
    low, rest = F.floor(t / unit), F.pmod(t, F.lit(unit))
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (low % 2 == 1))
    n = low + up.cast("bigint")
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def format_duration(secs: Column) -> Column:
    t = F.greatest(secs, F.lit(0.0)).cast("bigint")
    h, m, s = F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60
    two = [F.lpad(x.cast("string"), 2, "0") for x in (m, s)]
    text = F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two[0], F.lit(":"), two[1])).otherwise(F.concat(m.cast("string"), F.lit(":"), two[1]))
    return F.when(secs.isNotNull(), text)


def format_bitrate(bps: Column) -> Column:
    return F.when(bps >= 1 << 20, F.concat(tenths(bps, 1 << 20), F.lit(" Mb/s"))).otherwise(F.concat(F.floor(bps / 1024).cast("string"), F.lit(" kb/s")))


def format_size(size: Column) -> Column:
    """Binary units with up to two decimals, trailing zeros cut; bytes as a whole number."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        scaled = F.round(size / F.lit(float(1 << 10 * k)), 2).cast("decimal(20,2)").cast("string")
        out = F.when(size >= 1 << 10 * k, F.concat(F.regexp_replace(scaled, r"\.?0+$", ""), F.lit(" " + unit))).otherwise(out)
    return out


def format_date(secs: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss in the session's time zone."""
    return F.date_format(F.timestamp_seconds(secs), "yyyy-MM-dd HH:mm:ss")


def log_line(path: Column, size: Column, duration_ms: Column, width: Column, height: Column) -> Column:
    dims = F.coalesce(F.concat(width.cast("string"), F.lit("x"), height.cast("string")), F.lit("?x?"))
    return F.concat(path, F.lit(" - "), tenths(size, 1 << 20), F.lit(" MB, "), dims, F.lit(", "), tenths(duration_ms, 1000), F.lit("s duration"))
