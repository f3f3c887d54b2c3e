"""Frame operators. A frame is a row: video, win, f (its number), width, height, frame (binary, one byte per
pixel, row by row, as decoders give it). What concerns one frame needs no shuffle; what concerns a window or a
video gathers its frames, of which there are a fixed few."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..config import FRAME_SIDE, FRAMES, KEPT

# Thresholds of the black-frame and letterbox tests.
BLACK_LEVEL, BLACK_SHARE = 0x20, 0.80
MODE_MAX, MODE_NEAR, STRIP_SHARE = 32, 16, 0.90
SAMPLES = 8
PRESCAN = (160, 120)


@F.pandas_udf(BooleanType())
def is_black(frames: pd.Series) -> pd.Series:
    """Whether the share of pixels at or under the level is high enough; an empty frame is black."""
    return pd.Series([len(b) == 0 or np.count_nonzero(np.frombuffer(b, np.uint8) <= BLACK_LEVEL) / len(b) >= BLACK_SHARE for b in frames], dtype=bool)


def black_frames(frames: DataFrame) -> DataFrame:
    """The rows with is_black."""
    return frames.withColumn("is_black", is_black("frame"))


def fill_black(frames: DataFrame) -> DataFrame:
    """Each black frame takes the next frame of its window that isn't, else the previous, else stays."""
    w = Window.partitionBy("video", "win").orderBy("f")
    good = F.when(~F.col("is_black"), F.col("frame"))
    following = F.first(good, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    before = F.last(good, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return black_frames(frames).withColumn("frame", F.coalesce(following, before, "frame")).select(*frames.columns)


def pad_frames(frames: Column, frame_bytes: int = FRAME_SIDE * FRAME_SIDE, n: int = FRAMES) -> Column:
    """array<binary> of n frames: surplus ones go, missing ones are black (zero)."""
    zero = F.unhex(F.lit("00" * frame_bytes))
    return F.slice(F.concat(frames, F.array_repeat(zero, n)), 1, n)


def sample_frames(pos: Column, total: Column, most: int = SAMPLES) -> Column:
    """Whether frame pos of total is one of the evenly stepped samples."""
    step = F.greatest(F.lit(1), F.floor(total / most))
    return (pos % step == 0) & (pos < step * most)


def line_modes(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each line (row of an array of bytes) the most frequent value, of equally frequent ones the greatest,
    and whether that is dark and most pixels are near it."""
    n, width = lines.shape
    counts = np.bincount((np.arange(n)[:, None] * 256 + lines).ravel(), minlength=n * 256).reshape(n, 256)
    mode = 255 - counts[:, ::-1].argmax(1)
    near = np.count_nonzero(np.abs(lines.astype(np.int16) - mode[:, None]) <= MODE_NEAR, axis=1)
    return mode, (mode <= MODE_MAX) & (near / width >= STRIP_SHARE)


def edges(frame: np.ndarray) -> tuple[int, int, int, int]:
    """left, right, top, bottom of a frame (height, width): strips from each edge until the first that is none,
    at most half; zero where nothing would be left."""
    h, w = frame.shape
    cols, rows = line_modes(frame.T)[1], line_modes(frame)[1]

    def run(strip: np.ndarray) -> int:
        half = strip[: len(strip) // 2]
        return len(half) if half.all() else int(half.argmin())

    left, right, top, bottom = run(cols), run(cols[::-1]), run(rows), run(rows[::-1])
    return (left, right, top, bottom) if left + right < w and top + bottom < h else (0, 0, 0, 0)


def _pixels(batch: pd.DataFrame) -> Iterator[np.ndarray]:
    for frame, w, h in zip(batch["frame"], batch["width"], batch["height"], strict=True):
        yield np.frombuffer(frame, np.uint8).reshape(h, w)


def strips(frames: DataFrame) -> DataFrame:
    """video, f, axis ('row' or 'col'), at, mode, is_strip for each line of each frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [line_modes(lines) for p in _pixels(batch) for lines in (p, p.T)]
            if not found:
                continue
            n = [len(mode) for mode, _ in found]
            yield pd.DataFrame({
                "video": np.repeat(np.repeat(batch["video"].to_numpy(), 2), n),
                "f": np.repeat(np.repeat(batch["f"].to_numpy(), 2), n),
                "axis": np.repeat(np.tile(np.array(["row", "col"], object), len(batch)), n),
                "at": np.concatenate([np.arange(k) for k in n]),
                "mode": np.concatenate([mode for mode, _ in found]),
                "is_strip": np.concatenate([strip for _, strip in found]),
            })

    return frames.select("video", "f", "width", "height", "frame").mapInPandas(run, "video long, f int, axis string, at int, mode int, is_strip boolean")


def letterbox(frames: DataFrame) -> DataFrame:
    """video, f, left, right, top, bottom: the bars of each frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([edges(p) for p in _pixels(batch)], np.int32).reshape(-1, 4)
            yield pd.DataFrame({"video": batch["video"], "f": batch["f"]} | {c: found[:, k] for k, c in enumerate(("left", "right", "top", "bottom"))})

    return frames.select("video", "f", "width", "height", "frame").mapInPandas(run, "video long, f int, left int, right int, top int, bottom int")


def combine_crops(crops: DataFrame) -> DataFrame:
    """Per video the least crop of each edge over the sampled frames; f counts from 0."""
    counted = crops.withColumn("total", F.count("*").over(Window.partitionBy("video")))
    kept = counted.filter(sample_frames(F.col("f"), F.col("total")))
    return kept.groupBy("video").agg(*[F.min(c).alias(c) for c in ("left", "right", "top", "bottom")])


def fixed4(c: Column) -> Column:
    return c.cast("decimal(20,10)").cast("decimal(12,4)").cast("string")


def crop_filter(left: Column, right: Column, top: Column, bottom: Column, width: int = PRESCAN[0], height: int = PRESCAN[1]) -> Column:
    """Decoder filter of a crop as fractions with four decimals; empty where there is nothing to crop."""
    cw, ch = 1.0 - (left + right) / width, 1.0 - (top + bottom) / height
    parts = [F.lit("crop=iw*"), fixed4(cw), F.lit(":ih*"), fixed4(ch), F.lit(":iw*"), fixed4(left / width), F.lit(":ih*"), fixed4(top / height), F.lit(",")]
    return F.when(left + right + top + bottom > 0, F.concat(*parts)).otherwise(F.lit(""))


def cosines(n: int = FRAME_SIDE) -> np.ndarray:
    """The un-normalised DCT-II matrix: C[k, i] = cos(pi k (2i + 1) / 2n)."""
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.cos(math.pi * k * (2 * i + 1) / (2 * n))


def hash_cube(cube: np.ndarray, true3d: bool = False) -> bytes:
    """128 bytes of a cube of frames (f, x, y) of 0..255: signs of the first coefficients, bit f*100 + x*10 + y,
    least bit first. The transform runs twice over y and once over x (see SURVEY Q1); true3d is another hash."""
    c = cosines()
    t = cube.astype(float) - 128.0
    if true3d:
        t = np.einsum("af,fxy->axy", c, t)
        t = np.einsum("kx,fxy->fky", c, np.einsum("ly,fxy->fxl", c, t))
    else:
        t = np.einsum("kx,fxy->fky", c, np.einsum("ly,fxy->fxl", c @ c, t))
    bits = (t[:KEPT, :KEPT, :KEPT] > 0.0).reshape(-1)
    return np.packbits(np.pad(bits, (0, 1024 - bits.size)), bitorder="little").tobytes()


def dct_hash(frames: DataFrame, true3d: bool = False) -> DataFrame:
    """video, win, bits (array of 16 longs) of each window's frames of FRAME_SIDE x FRAME_SIDE."""
    cubes = frames.groupBy("video", "win").agg(F.sort_array(F.collect_list(F.struct("f", "frame"))).alias("cells"))
    raw = cubes.select("video", "win", pad_frames(F.transform("cells", lambda c: c["frame"])).alias("frames"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cubes = (np.frombuffer(b"".join(x), np.uint8).reshape(-1, FRAME_SIDE, FRAME_SIDE).transpose(0, 2, 1) for x in batch["frames"])
            yield pd.DataFrame({"video": batch["video"], "win": batch["win"], "bits": [np.frombuffer(hash_cube(c, true3d), "<i8").tolist() for c in cubes]})

    return raw.mapInPandas(run, "video long, win int, bits array<long>")
