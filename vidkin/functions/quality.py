"""Ranking of files by resolution, codec and bit rate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Substrings of codec names by rank, tried in this order.
CODECS = ((4, "av1"), (3, "hevc|h265|265|vp9"), (2, "h264|264|avc|vp8"), (1, "mpeg|xvid|divx|wmv"))


def codec_rank(codec: Column) -> Column:
    out = F.lit(0)
    for rank, names in reversed(CODECS):
        out = F.when(F.rlike(F.lower(codec), F.lit(names)), rank).otherwise(out)
    return out


def quality_score(width: Column, height: Column, codec: Column, bitrate: Column) -> Column:
    pixels = F.coalesce(width, F.lit(0)).cast("bigint") * F.coalesce(height, F.lit(0)).cast("bigint")
    return F.struct(pixels.alias("pixels"), codec_rank(F.coalesce(codec, F.lit(""))).alias("codec"), F.coalesce(bitrate, F.lit(0).cast("bigint")).alias("bitrate"))
