"""Signatures from files through decoders that the caller gives.

probe(path) -> JSON text; frames(path, start, seconds, vf, n) -> raw bytes; audio(path) -> (i16 samples, rate);
thumbnail(path, at, w, h) -> (width, height, rgb bytes). `command_line` has ones that run ffprobe and ffmpeg.
Errors become rows.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..config import FRAME_SIDE, FRAMES, SignatureConfig
from ..functions.text import parse_probe
from ..functions.timeline import millis, window_positions
from ..operators.imaging import BLACK_LEVEL, BLACK_SHARE, PRESCAN, SAMPLES, edges, hash_cube

HASHES = "array<struct<start_ms:bigint,end_ms:bigint,bits:array<bigint>>>"


class command_line:
    """Decoders that run public command-line tools."""

    @staticmethod
    def probe(path: str) -> str:
        cmd = ["ffprobe", "-v", "quiet", "-print_format", "json", "-show_format", "-show_streams", "-select_streams", "v:0", path]
        return subprocess.run(cmd, capture_output=True, check=True, text=True, timeout=60).stdout

    @staticmethod
    def frames(path: str, start: float, seconds: float, vf: str, n: int, limit: float) -> bytes:
        cmd = ["ffmpeg", "-threads", "1", "-ss", f"{start:.3f}", "-t", f"{seconds:.3f}", "-i", path, "-vf", vf, "-vframes", str(n), "-f", "rawvideo", "-pix_fmt", "gray", "pipe:1"]
        return subprocess.run(cmd, capture_output=True, check=True, timeout=limit).stdout

    @staticmethod
    def thumbnail(path: str, at: float, w: int, h: int) -> bytes:
        cmd = ["ffmpeg", "-ss", f"{at:.3f}", "-i", path, "-vframes", "1", "-vf", f"scale={w}:{h}:force_original_aspect_ratio=decrease", "-f", "image2pipe", "-vcodec", "png", "pipe:1"]
        return subprocess.run(cmd, capture_output=True, check=True, timeout=60).stdout


def probed(files: DataFrame, probe: Callable[[str], str]) -> DataFrame:
    """files with metadata and error."""

    @F.pandas_udf("struct<json:string,error:string>")
    def run(paths: pd.Series) -> pd.DataFrame:
        out = []
        for p in paths:
            try:
                out.append((probe(p), None))
            except Exception as e:  # noqa: BLE001  any failure of a file is a row
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["json", "error"])

    rows = files.withColumn("_p", run("path")).withColumn("metadata", parse_probe(F.col("_p.json")))
    return rows.withColumn("error", F.coalesce("_p.error", F.when(F.col("metadata").isNull(), F.lit("no duration found")))).drop("_p")


def crop_of(frames: np.ndarray) -> tuple[int, int, int, int]:
    """left, right, top, bottom common to sampled frames (n, h, w)."""
    found = [edges(f) for f in frames[:: max(1, len(frames) // SAMPLES)][:SAMPLES]]
    return tuple(map(min, zip(*found, strict=True))) if found else (0, 0, 0, 0)


def fill_black(cube: np.ndarray) -> np.ndarray:
    good = np.nonzero((cube <= BLACK_LEVEL).mean((1, 2)) < BLACK_SHARE)[0]
    if not len(good):
        return cube
    at = np.searchsorted(good, np.arange(len(cube)))
    return cube[np.where(at < len(good), good[np.minimum(at, len(good) - 1)], good[-1])]


def build_signatures(files: DataFrame, cfg: SignatureConfig, probe: Callable, frames: Callable, fingerprint: Callable | None = None) -> DataFrame:
    """files with metadata, duration_ms, aspect_ratio, visual_hashes, audio_fingerprint, outcome and error.
    Settings of window positions are evaluated by Spark, decoding by one Arrow pass per file."""
    rows = probed(files, probe)
    duration = F.col("metadata.duration_secs")
    rows = rows.withColumns({"_windows": F.to_json(window_positions(duration, cfg)), "duration_ms": millis(duration)})
    wants_audio = cfg.audio_fingerprint and fingerprint is not None

    made = StructType.fromDDL(f"_hashes {HASHES}, _fp array<bigint>, _error string")
    types = to_arrow_schema(made)

    def signature(path: str, text: str | None) -> tuple:
        if text is None:
            return None, None, None
        try:
            spans = [(w["start"], w["end"]) for w in json.loads(text)]
            crop = ""
            if cfg.cropdetect:
                s, e = spans[len(spans) // 2]
                w, h = PRESCAN
                raw = frames(path, s, e - s, f"fps={8 / max(e - s, 0.1):.4f},scale={w}:{h}:flags=bilinear,format=gray", 8, cfg.timeout.seconds(e - s))
                n = len(raw) // (w * h)
                left, right, top, bottom = crop_of(np.frombuffer(raw[: n * w * h], np.uint8).reshape(n, h, w))
                if left + right + top + bottom:
                    crop = f"crop=iw*{1 - (left + right) / w:.4f}:ih*{1 - (top + bottom) / h:.4f}:iw*{left / w:.4f}:ih*{top / h:.4f},"
            hashes = []
            for s, e in spans:
                vf = f"fps={FRAMES / max(e - s, 0.1):.4f},{crop}scale={FRAME_SIDE}:{FRAME_SIDE}:flags=bilinear,format=gray"
                raw = frames(path, s, e - s, vf, FRAMES, cfg.timeout.seconds(e - s))
                size = FRAME_SIDE * FRAME_SIDE
                raw = raw[: len(raw) // size * size][: FRAMES * size].ljust(FRAMES * size, b"\0")
                cube = fill_black(np.frombuffer(raw, np.uint8).reshape(FRAMES, FRAME_SIDE, FRAME_SIDE)).transpose(0, 2, 1)
                hashes.append({"start_ms": int(max(s, 0) * 1000), "end_ms": int(max(e, 0) * 1000), "bits": np.frombuffer(hash_cube(cube), "<i8").tolist()})
            fp = None
            if wants_audio:
                try:
                    fp = [int(x) for x in fingerprint(path)] or None
                except Exception:  # noqa: BLE001  sound that can't be read counts as none
                    fp = None
            return hashes, fp, None
        except Exception as e:  # noqa: BLE001  any failure of a file is a row
            return None, None, f"{type(e).__name__}: {e}"

    at = [rows.columns.index(c) for c in ("path", "_windows")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [signature(p, w) for p, w in zip(*(batch.column(k).to_pylist() for k in at), strict=True)]
            new = [pa.array([x[k] for x in out], field.type) for k, field in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *types.names])

    # A map over whole rows, so that a file is decoded once whatever is read of it later.
    done = rows.mapInArrow(run, StructType([*rows.schema.fields, *made.fields])).withColumn("error", F.coalesce("error", "_error"))
    ratio = F.coalesce((F.col("metadata.width") / F.nullif("metadata.height", F.lit(0))).cast("float"), F.lit(16 / 9).cast("float"))
    return done.withColumns(
        {"aspect_ratio": ratio, "visual_hashes": F.col("_hashes"), "audio_fingerprint": F.col("_fp"), "outcome": F.when(F.col("error").isNull(), "Computed").otherwise("Error")}
    ).drop("_hashes", "_fp", "_error", "_windows")


def thumbnails(rows: DataFrame, thumbnail: Callable, width: int = 160, height: int = 90) -> DataFrame:
    """rows (path, duration_secs) with thumbnail; a failure gives NULL."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, secs in zip(batch["path"], batch["duration_secs"], strict=True):
                try:
                    out.append(thumbnail(path, 1.0 if secs is None or secs != secs else max(secs * 0.2, 1.0), width, height))
                except Exception:  # noqa: BLE001  failures are dropped
                    out.append(None)
            yield pd.DataFrame({"path": batch["path"], "thumbnail": out})

    found = rows.select("path", "duration_secs").distinct().mapInPandas(run, "path string, thumbnail binary")
    return rows.join(found, "path", "left")
