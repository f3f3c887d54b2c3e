"""Inputs of the queries, derived from the driver's tables with integer arithmetic (see FIXTURES.md)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CompareConfig, SignatureConfig
from ..sources.cache import cache_key

SIG_CONFIG = CompareConfig(hash_bits=16)
FILE_CONFIG = SignatureConfig()
NOW = 1_702_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    e = e.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("v"))
    bits = """transform(sequence(0, 3), w -> named_struct('start_ms', CAST(6000 * w AS BIGINT), 'bits', array(aggregate(sequence(0, 15), 0L, (s, k) -> s + IF(
      (embedding[16 * w + k] > 0) <> CASE v WHEN 1 THEN (vec_id * 31 + (16 * w + k) * 17) % 100 < 2 WHEN 2 THEN (vec_id * 31 + (16 * w + k) * 17) % 100 < 15
        WHEN 3 THEN w < 2 WHEN 4 THEN w <> 2 ELSE false END, shiftleft(1L, k), 0L)))))"""
    whole = F.expr(bits)
    base = 20000 + (F.col("vec_id") * F.col("vec_id") * 131) % 4000 * 100
    return e.select(
        (F.col("vec_id") * 6 + F.col("v")).alias("input_pos"),
        F.concat(F.lit("/v/"), F.col("vec_id").cast("string"), F.lit("_"), F.col("v").cast("string"), F.lit(".mp4")).alias("path"),
        (base + F.when(F.col("v") == 5, -50).otherwise(F.col("v") * 137)).cast("bigint").alias("duration_ms"),
        F.when(F.col("v") == 5, F.slice(whole, 3, 2)).otherwise(whole).alias("visual_hashes"),
    )


SIGNATURES_SQL = """
cells AS (
  SELECT vec_id, v, i // 16 AS w,
         sum(CASE WHEN (embedding[i + 1] > 0) <> (CASE v WHEN 1 THEN (vec_id * 31 + i * 17) % 100 < 2 WHEN 2 THEN (vec_id * 31 + i * 17) % 100 < 15
                  WHEN 3 THEN i // 16 < 2 WHEN 4 THEN i // 16 <> 2 ELSE false END) THEN 1::BIGINT << (i % 16)::INT ELSE 0 END)::BIGINT AS bits
  FROM embeddings, (SELECT unnest(range(64)) AS i), (SELECT unnest(range(6)) AS v)
  GROUP BY ALL),
sig AS (
  SELECT vec_id * 6 + v AS input_pos, '/v/' || vec_id || '_' || v || '.mp4' AS path,
         (20000 + (vec_id * vec_id * 131) % 4000 * 100 + CASE WHEN v = 5 THEN -50 ELSE v * 137 END)::BIGINT AS duration_ms,
         list({'start_ms': (6000 * w)::BIGINT, 'bits': bits} ORDER BY w) AS h
  FROM cells WHERE v <> 5 OR w >= 2 GROUP BY vec_id, v)"""


def _value(k, s, f, x, y):
    return ((k + 1) * (x + 3) * (y + 5) * (f + 2) + s * x * f + 7 * y * y + 3 * x * x * x) % 251


def _frames(spark: SparkSession, sf_dir: str, n: int, width: int, height: int, draw) -> DataFrame:
    """video, win, f, width, height, frame: n frames of every part."""
    x, y = np.arange(width)[None, :], np.arange(height)[:, None]

    @F.pandas_udf("binary")
    def drawn(k: pd.Series, s: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series([draw(a, b, c, x, y).astype(np.uint8).tobytes() for a, b, c in zip(k, s, f, strict=True)])

    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("video"), F.col("p_size").cast("bigint").alias("s"))
    # The narrow rows are dealt by video before they grow to frames, which then need no shuffle of their own.
    rows = rows.repartition(spark.sparkContext.defaultParallelism, "video").withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.select("video", F.lit(0).alias("win"), "f", F.lit(width).alias("width"), F.lit(height).alias("height"), drawn("video", "s", "f").alias("frame"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One window of 16 frames of 16x16; every fifth frame is black."""

    def draw(k, s, f, x, y):
        p = _value(k, s, f, x, y)
        return p % 33 if (k + f) % 5 == 0 else p

    return _frames(spark, sf_dir, 16, 16, 16, draw)


_P = "(((k + 1) * (x + 3) * (y + 5) * (f + 2) + s * x * f + 7 * y * y + 3 * x * x * x) % 251)"
PIXELS_SQL = f"""
pix AS (
  SELECT k AS video, f::INT AS f, x::INT AS x, y::INT AS y, (CASE WHEN (k + f) % 5 = 0 THEN {_P} % 33 ELSE {_P} END)::INT AS p
  FROM (SELECT p_partkey::BIGINT AS k, p_size::BIGINT AS s FROM part),
       (SELECT unnest(range(16)) AS f), (SELECT unnest(range(16)) AS x), (SELECT unnest(range(16)) AS y))"""


def barred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 frames of 32x24 with dark bars; every tenth video is dark all over."""

    def draw(k, s, f, x, y):
        p = _value(k, s, f, x, y)
        return np.where((y < s % 4) | (y >= 24 - s % 3) | (x < s % 5) | (k % 10 == 0), p % 8, p)

    return _frames(spark, sf_dir, 8, 32, 24, draw)


BARRED_SQL = f"""
bar AS (
  SELECT k AS video, f::INT AS f, x::INT AS x, y::INT AS y,
         (CASE WHEN y < s % 4 OR y >= 24 - s % 3 OR x < s % 5 OR k % 10 = 0 THEN {_P} % 8 ELSE {_P} END)::INT AS p
  FROM (SELECT p_partkey::BIGINT AS k, p_size::BIGINT AS s FROM part),
       (SELECT unnest(range(8)) AS f), (SELECT unnest(range(32)) AS x), (SELECT unnest(range(24)) AS y))"""


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, group_id, and the parts of a probe's JSON text."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("k"), F.col("o_custkey").cast("bigint").alias("group_id"), F.col("o_totalprice").cast("decimal(12,2)").cast("string").alias("t"))
    sql = PROBE_TEXT
    return o.selectExpr("k AS file_id", "group_id", f"{sql} AS json")


_DUR = """CASE k % 7 WHEN 0 THEN concat('"duration":"', t, '",') WHEN 1 THEN '"duration":"01:02:03.500",' WHEN 2 THEN '"duration":"02:30.000",' WHEN 3 THEN '"duration":"N/A",'
 WHEN 4 THEN '' WHEN 5 THEN concat('"duration":', t, ',') ELSE '"duration":" 12.5 ",' END"""
_FPS = """CASE k % 5 WHEN 0 THEN '"avg_frame_rate":"30000/1001",' WHEN 1 THEN '"avg_frame_rate":"25/1",' WHEN 2 THEN '"avg_frame_rate":"0/0","r_frame_rate":"24/1",'
 WHEN 3 THEN '"avg_frame_rate":"abc",' ELSE '"r_frame_rate":"50/2",' END"""
_CODEC = """CASE k % 8 WHEN 0 THEN '"codec_name":"av1",' WHEN 1 THEN '"codec_name":"hevc",' WHEN 2 THEN '"codec_name":"h264",' WHEN 3 THEN '"codec_name":"vp9",'
 WHEN 4 THEN '"codec_name":"mpeg4",' WHEN 5 THEN '"codec_name":"xvid",' WHEN 6 THEN '"codec_name":"theora",' ELSE '' END"""
_DIM = """CASE k % 4 WHEN 0 THEN '"width":1920,"height":1080,' WHEN 1 THEN '"width":1280,"height":720,' WHEN 2 THEN CASE WHEN k % 100 = 2 THEN '"width":854,"height":20000,' ELSE '"width":854,"height":480,' END ELSE '' END"""
_RATE = """CASE WHEN k % 3 = 0 THEN '' ELSE concat('"bit_rate":"', CAST((k % 50) * 100000 AS VARCHAR(20)), '",') END"""
#: Text that both engines build alike.
PROBE_TEXT = f"""concat('{{"streams":[{{', {_DUR}, {_FPS}, {_CODEC}, {_DIM}, {_RATE}, '"index":0}}],"format":{{', CASE WHEN k % 7 = 4 THEN concat('"duration":"', t, '"') ELSE '"x":1' END, '}}}}')"""
PROBES_SQL = f"""
probe AS (SELECT k AS file_id, group_id, {PROBE_TEXT} AS json
  FROM (SELECT o_orderkey::BIGINT AS k, o_custkey::BIGINT AS group_id, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS t FROM orders))"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, size, mtime, doc_id."""
    ext = F.element_at(F.array(*[F.lit(x) for x in (".mp4", ".MKV", ".txt", ".WebM", ".m2ts", "")]), (F.col("doc_id") % 6 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return d.select(
        "doc_id", F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"),
        F.col("n_chars").alias("size"), (F.lit(1_700_000_000) + F.col("doc_id") * 3600).cast("bigint").alias("mtime"),
    )


FILES_SQL = """
files AS (SELECT doc_id, '/' || source || '/' || lang || '/' || doc_id || (['.mp4', '.MKV', '.txt', '.WebM', '.m2ts', ''])[(doc_id % 6 + 1)::INT] AS path,
  n_chars AS size, 1700000000 + doc_id * 3600 AS mtime FROM documents)"""
KEY_SQL = "sha256(concat_ws(chr(1), path, CAST({size} AS VARCHAR), CAST(mtime AS VARCHAR), '1|15.0|5|6.0|1|0'))"


def cache_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the files with their key, a third with a stale size, a third absent."""
    f = files(spark, sf_dir).filter("doc_id % 3 < 2").withColumn("size", F.col("size") + (F.col("doc_id") % 3))
    key = cache_key(F.col("path"), F.col("size"), F.col("mtime"), FILE_CONFIG)
    return f.select("path", "size", "mtime", key.alias("cache_key"), (F.col("mtime") + 86400).alias("last_used"))


CACHE_SQL = f"""
cache AS (SELECT path, size + doc_id % 3 AS size, mtime, {KEY_SQL.format(size='size + doc_id % 3')} AS cache_key, mtime + 86400 AS last_used FROM files WHERE doc_id % 3 < 2)"""
