"""Audio: silence gate, segment scoring and match edges.

Fingerprint alignment follows the public Chromaprint matching idea (offset histogram, then bit errors
per item along the best offsets); it is equivalent in kind, not bit-verified against another matcher.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CompareConfig
from ..functions.bits import f32
from .matching import blocked_pairs, edges_of

#: Seconds per fingerprint item (4096-sample frames at 11025 Hz, two thirds overlapping).
ITEM_SECS = 4096 / 3 / 11025
SEGMENTS = "array<struct<duration:float,score:double>>"


def silence(samples: DataFrame, key: str, value: str) -> DataFrame:
    """key, rms, peak, silent of i16 samples (all channels): silent when rms < 0.001 and peak < 0.01."""
    v = F.col(value) / 32767.0
    by = samples.groupBy(key).agg(F.sqrt(F.avg(v * v)).alias("rms"), F.max(F.abs(v)).alias("peak"))
    return by.withColumn("silent", (F.col("rms") < 0.001) & (F.col("peak") < 0.01))


def segment_score(segments: Column, cfg: CompareConfig) -> Column:
    """FLOAT: 1 - min(best/max_difference, 1) over segments long and good enough (both strict); 0 without any."""
    good = F.filter(segments, lambda s: (s["duration"] > f32(cfg.audio_min_segment_duration)) & (s["score"] < cfg.audio_max_difference))
    best = F.array_min(F.transform(good, lambda s: s["score"]))
    return F.when(F.size(good) > 0, (1.0 - F.least(best / cfg.audio_max_difference, F.lit(1.0))).cast("float")).otherwise(f32(0.0))


def audio_kind(score: Column) -> Column:
    """Identical from 0.95, SameContent above 0, else NULL."""
    name = F.when(score >= f32(0.95), "Identical").when(score > f32(0.0), "SameContent")
    return F.when(name.isNotNull(), F.struct(name.alias("kind"), F.lit(None).cast("bigint").alias("offset_ms"), F.lit(None).cast("string").alias("clip_is")))


def align(a: np.ndarray, b: np.ndarray, offsets: int | None = None, worst: float = 10.0) -> list[tuple[float, float]]:
    """Segments (seconds, mean differing bits) of two fingerprints along all offsets at which an item agrees, or along
    the most frequent ones."""
    if not len(a) or not len(b):
        return []
    order = np.argsort(b >> np.uint32(4), kind="stable")
    keys = (b >> np.uint32(4))[order]
    low, high = np.searchsorted(keys, a >> np.uint32(4), "left"), np.searchsorted(keys, a >> np.uint32(4), "right")
    n = high - low
    if not n.sum():
        return []
    at = np.repeat(np.arange(len(a)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    shift, count = np.unique(order[np.repeat(low, n) + within] - at, return_counts=True)
    out = []
    for s in shift[np.argsort(-count, kind="stable")[:offsets]]:
        start, end = max(0, -s), min(len(a), len(b) - s)
        errors = np.bitwise_count(a[start:end] ^ b[start + s : end + s]).astype(float)
        smooth = np.convolve(errors, np.ones(5) / 5, "same") if len(errors) >= 5 else errors
        good = np.concatenate([[False], smooth < worst, [False]])
        edge = np.nonzero(good[1:] != good[:-1])[0]
        out += [((e - b0) * ITEM_SECS, float(errors[b0:e].mean())) for b0, e in zip(edge[::2], edge[1::2], strict=True)]
    return out


def audio_edges(bucketed: DataFrame, cfg: CompareConfig) -> DataFrame:
    """Match edges of one bucket by audio: both fingerprints non-empty, and an accepted segment."""
    rows = bucketed.filter(F.size("audio_fingerprint") > 0)
    # Segments come from items that agree but for their last bits: a pair without one is left out before its
    # fingerprints are fetched. A fingerprint's distinct keys are summed up in 1024 bits.
    key = F.transform("audio_fingerprint", lambda x: (F.shiftright(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)), 4) % 1024).cast("int"))
    words = [_word(F.array_distinct(key), w) for w in range(16)]
    summed = rows.select("bucket_id", "input_pos", "duration_ms", *[w.alias(f"w{k}") for k, w in enumerate(words)])
    shared = reduce(or_, [F.col(f"a_w{k}").bitwiseAND(F.col(f"b_w{k}")) != 0 for k in range(16)])
    pairs = blocked_pairs(summed, [f"w{k}" for k in range(16)], shared)

    @F.pandas_udf(SEGMENTS)
    def segments(x: pd.Series, y: pd.Series) -> pd.Series:
        found = [align(np.asarray(p, np.int64).astype(np.uint32), np.asarray(q, np.int64).astype(np.uint32)) for p, q in zip(x, y, strict=True)]
        return pd.Series([[{"duration": d, "score": s} for d, s in f] for f in found])

    for side in "ab":
        held = rows.select(F.col("input_pos").alias(f"{side}_input_pos"), *[F.col(c).alias(f"{side}_{c}") for c in ("path", "audio_fingerprint")])
        pairs = pairs.join(held, f"{side}_input_pos")
    joined = pairs.withColumn("segments", segments("a_audio_fingerprint", "b_audio_fingerprint"))
    scored = joined.withColumn("visual_score", segment_score(F.col("segments"), cfg)).withColumn("kind", audio_kind(F.col("visual_score")))
    return edges_of(scored.filter("kind is not null"))


def _word(keys: Column, w: int) -> Column:
    """The w-th 64 of the bits that keys name."""
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), (k % 64).cast("int"))
    return F.aggregate(F.filter(keys, lambda k: F.floor(k / 64) == w), F.lit(0).cast("bigint"), lambda s, k: s.bitwiseOR(bit(k)))
