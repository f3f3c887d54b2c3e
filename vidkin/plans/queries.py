"""Queries of the media operators over the driver's tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SignatureConfig, Timeout
from ..functions import formats, quality, text, timeline
from ..functions.bits import hamming as hamming_of
from ..operators import audio, imaging, matching, report
from ..sources import cache, files
from . import fixtures as fx

CFG = fx.SIG_CONFIG


def _r(name: str, c=None):
    return F.round((F.col(name) if c is None else c).cast("double"), 6).alias(name)


# Files and cache


def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the data folder itself: names and sizes."""
    found = files.list_files(spark, [sf_dir]).filter(F.col("path").contains(".parquet"))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "size")


def ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.files(spark, sf_dir).filter(files.media_extension(F.col("path"))).select("path", "size")


def scan_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = fx.files(spark, sf_dir)
    again = one.filter("doc_id % 4 = 0").withColumn("path", F.concat(F.lit("/"), F.regexp_replace("path", "/([^/]*)$", "/./$1")))
    both = one.unionByName(again).filter(files.media_extension(F.col("path")))
    return files.distinct_paths(both.select("path")).select("path")


def path_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each path sorts before two others, by component."""
    paths = fx.files(spark, sf_dir).select("path").unionAll(spark.createDataFrame([("/a/b",), ("/a-b",)], "path string"))
    near = paths.select("path", F.explode(F.array(F.lit("/a/b"), F.lit("/a-b"))).alias("other"))
    return near.select("path", "other", (files.path_order(F.col("path")) < files.path_order(F.col("other"))).alias("before"))


def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.with_key(fx.files(spark, sf_dir), fx.FILE_CONFIG).select("path", "cache_key")


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.hits(fx.files(spark, sf_dir), fx.cache_table(spark, sf_dir), fx.FILE_CONFIG).select("path", "cache_key", "last_used")


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.misses(fx.files(spark, sf_dir), fx.cache_table(spark, sf_dir), fx.FILE_CONFIG).select("path", "cache_key")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached files, then computed ones, of which those without an extension fail."""
    hit = cache_hits(spark, sf_dir).select("path", F.lit("Cached").alias("outcome"), F.lit(None).cast("string").alias("error"))
    miss = cache_misses(spark, sf_dir)
    bad = ~F.col("path").contains(".")
    computed = miss.select("path", F.when(bad, "Error").otherwise("Computed").alias("outcome"), F.when(bad, F.concat(F.lit("ERROR: "), "path", F.lit(" - no decoder"))).alias("error"))
    return hit.unionByName(computed)


def cache_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).filter("error is null").select("path", "outcome")


def cache_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.fresh(fx.cache_table(spark, sf_dir), 30, F.lit(fx.NOW)).select("path", "last_used")


def outcome_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"), F.count("error").alias("errors"), F.min("error").alias("first_error"))


def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _outcomes(spark, sf_dir)
    return o.agg(F.count("*").alias("found"), F.count_if(F.col("outcome") == "Cached").alias("cached"), F.count_if(F.col("outcome") != "Cached").alias("uncached"), F.count("error").alias("errors"), F.count_if(F.col("error").isNull()).alias("signatures"))


def log_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.files(spark, sf_dir)
    known = F.col("doc_id") % 2 == 0
    return f.select("path", formats.log_line(F.col("path"), F.col("size") * 1000, F.col("mtime") % 100000, F.when(known, F.lit(1280)), F.when(known, F.lit(720))).alias("line"))


# Metadata


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.probes(spark, sf_dir).select("file_id", "group_id", text.parse_probe(F.col("json")).alias("m"))
    return m.select("file_id", "group_id", "m.*")


def metadata_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _meta(spark, sf_dir)
    ratio = F.coalesce(text.aspect_ratio(F.col("width"), F.col("height")), F.lit(16 / 9).cast("float"))
    return m.select("file_id", _r("duration_secs"), _r("fps"), "codec", "bitrate_bps", "width", "height", _r("aspect_ratio", ratio))


def parse_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("file_id"), F.col("o_totalprice").cast("decimal(12,2)").cast("string").alias("t"))
    k = F.col("file_id")
    raw = F.when(k % 7 == 0, F.col("t")).when(k % 7 == 1, "01:02:03.500").when(k % 7 == 2, "02:30.000").when(k % 7 == 3, "N/A").when(k % 7 == 5, F.concat(F.lit("-"), "t")).when(k % 7 == 6, " 12.5 ")
    return t.select("file_id", _r("secs", text.parse_duration(raw)))


def parse_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("bigint")
    raw = F.when(k % 6 == 0, "30000/1001").when(k % 6 == 1, F.concat((k % 120).cast("string"), F.lit("/1"))).when(k % 6 == 2, "0/0").when(k % 6 == 3, "abc").when(k % 6 == 4, "25")
    return fx.table(spark, sf_dir, "orders").select(k.alias("file_id"), _r("fps", text.parse_fps(raw)))


def _durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("file_id"), ((F.col("o_orderkey") * 37) % 4000 / F.lit(8.0)).alias("secs"))


def timeout_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _durations(spark, sf_dir).select("file_id", _r("limit_secs", timeline.timeout(F.col("secs"), Timeout(10, 5, 20, 120))), _r("inverted", timeline.timeout(F.col("secs"), Timeout(0, 0, 30, 10))))


def window_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _durations(spark, sf_dir).select("file_id", F.posexplode(timeline.window_positions(F.col("secs"), SignatureConfig())).alias("win", "w"))
    return w.select("file_id", F.col("win").cast("bigint").alias("win"), F.round("w.start", 9).alias("start_secs"), F.round("w.end", 9).alias("end_secs"))


def thumb_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _durations(spark, sf_dir).select("file_id", F.round(timeline.thumb_seek(F.col("secs")).cast("double"), 3).alias("seek"))


# Imaging


def frame_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames per window after padding: how many, and how many of them are zero, from windows cut short."""
    rows = fx.pixels(spark, sf_dir).filter("f < 4 + video % 16")
    wins = rows.groupBy("video").agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "frame"))), lambda s: s["frame"]).alias("frames"))
    padded = wins.select("video", F.size("frames").alias("had"), imaging.pad_frames(F.col("frames")).alias("frames"))
    zero = F.filter("frames", lambda b: b == F.unhex(F.lit("00" * 256)))
    return padded.select("video", F.col("had").cast("bigint").alias("had"), F.size("frames").cast("bigint").alias("n_frames"), F.size(zero).cast("bigint").alias("n_zero"))


def frame_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("video"), F.col("p_size").cast("bigint").alias("total"))
    pos = n.select("video", "total", F.explode(F.sequence(F.lit(0), F.col("total") - 1)).alias("pos"))
    return pos.filter(imaging.sample_frames(F.col("pos"), F.col("total"))).select("video", F.col("pos").cast("bigint").alias("pos"))


def black_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.black_frames(fx.pixels(spark, sf_dir)).select("video", "f", "is_black")


def black_frame_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = np.arange(16)[None, :] * 16 + np.arange(16)[:, None] + 1

    @F.pandas_udf("long")
    def checksum(frames: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(b, np.uint8) @ weight.ravel()) for b in frames], dtype="int64")

    return imaging.fill_black(fx.pixels(spark, sf_dir)).select("video", "f", checksum("frame").alias("checksum"))


def letterbox_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.strips(fx.barred(spark, sf_dir)).select("video", "f", "axis", "at", "mode", "is_strip")


def letterbox_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.letterbox(fx.barred(spark, sf_dir))


def crop_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.combine_crops(imaging.letterbox(fx.barred(spark, sf_dir)))


def crop_filter_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = crop_combine(spark, sf_dir)
    return c.select("video", imaging.crop_filter(*[F.col(x) for x in ("left", "right", "top", "bottom")], 32, 24).alias("vf"))


def dct_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = imaging.dct_hash(fx.pixels(spark, sf_dir)).select("video", "bits", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("f"))
    bit = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: _bit(F.col("bits"), F.col("f") * 100 + i))
    return h.select("video", "f", F.array_join(bit, "").alias("bits"))


def _bit(words, i):
    return F.call_function("getbit", F.get(words, F.floor(i / 64).cast("int")), (i % 64).cast("int")).cast("string")


# Matching


def hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of each original's windows to those of its variants 1 to 4."""
    s = fx.signatures(spark, sf_dir).withColumns({"vec": F.floor(F.col("input_pos") / 6), "v": F.col("input_pos") % 6})
    a = s.filter("v = 0").select("vec", F.col("visual_hashes").alias("a"))
    b = s.filter("v between 1 and 4").select("vec", "v", F.col("visual_hashes").alias("b"))
    d = F.transform(F.arrays_zip("a", "b"), lambda z: hamming_of(z["a"]["bits"], z["b"]["bits"], 16).cast("string"))
    return a.join(b, "vec").select("vec", "v", F.array_join(d, ",").alias("d"))


def _bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.duration_buckets(fx.signatures(spark, sf_dir), CFG.duration_tolerance_pct)


def duration_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucketed(spark, sf_dir).select("path", "duration_ms", F.col("bucket_id").cast("bigint").alias("bucket_id"))


def prefilter_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = matching.candidate_pairs(_bucketed(spark, sf_dir), CFG, ["a_path", "b_path", "differing"])
    return pairs.select("a_path", "b_path", matching.pairing.rounded_distance(F.col("differing"), CFG, 6).alias("d_mid"))


def window_match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.window_counts(_bucketed(spark, sf_dir), CFG).select("a_path", "b_path", "n_matching", "n_windows")


def pair_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = matching.match_edges(fx.signatures(spark, sf_dir), CFG)
    return e.select("a_path", "b_path", _r("visual_score"), "kind.kind", "kind.offset_ms", "kind.clip_is")


def subclip_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each clip against each variant of its original."""
    s = fx.signatures(spark, sf_dir).withColumns({"vec": F.floor(F.col("input_pos") / 6), "v": F.col("input_pos") % 6})
    clip = s.filter("v = 5").select("vec", F.col("visual_hashes").alias("clip"))
    source = s.filter("v < 5").select("vec", "v", F.col("visual_hashes").alias("source"))
    best = clip.join(source, "vec").select("vec", "v", matching.best_alignment(F.col("clip"), F.col("source"), CFG).alias("best"))
    return best.select("vec", "v", _r("score", F.col("best.score")), "best.offset_ms")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.find_members(fx.signatures(spark, sf_dir), CFG)


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = matching.groups(_members(spark, sf_dir))
    return g.select("leader_pos", "kind.kind", "kind.offset_ms", F.size("files").cast("bigint").alias("n_files"), F.array_join("files", "|").alias("files"))


def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).select("leader_path", "path", "kind.kind")


# Audio


def audio_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.floor(F.col("value") * 10))
    s = audio.silence(fx.table(spark, sf_dir, "events").select("user_id", v.cast("double").alias("v")), "user_id", "v")
    return s.select("user_id", _r("rms"), _r("peak"), "silent")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair"), F.struct(F.col("l_quantity").cast("float").alias("duration"), (F.round(F.col("l_discount") * 100) * 1.0).alias("score")).alias("s"))
    return s.groupBy("pair").agg(F.collect_list("s").alias("segments"))


def audio_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select("pair", _r("score", audio.segment_score(F.col("segments"), CFG)))


def audio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _segments(spark, sf_dir).select("pair", audio.segment_score(F.col("segments"), CFG).alias("score"))
    return s.withColumn("kind", audio.audio_kind(F.col("score"))).filter("kind is not null").select("pair", "kind.kind")


# Reports


def codec_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _meta(spark, sf_dir).select("file_id", quality.codec_rank(F.coalesce("codec", F.lit(""))).alias("codec_rank"))


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.quality_tiers(_meta(spark, sf_dir))


def quality_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiers(spark, sf_dir).select("file_id", "tier")


def keep_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.keep_one(_tiers(spark, sf_dir), pos="file_id").select("file_id", "checked")


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _meta(spark, sf_dir).withColumn("path", F.concat(F.lit("/m/"), F.col("file_id").cast("string"), F.lit(".mkv")))
    members = m.select("group_id", F.col("file_id").alias("pos"), "path")
    stats = m.select("path", (F.col("file_id") * 7919).alias("size"), (1_700_000_000 + F.col("file_id")).alias("mtime"))
    meta = m.filter("file_id % 10 <> 9 and duration_secs is not null").drop("file_id", "group_id")
    rows = report.report_rows(members, meta, stats)
    return rows.select("pos", "tier", "name", "size_text", "dimensions", "duration", "bitrate", "codec", "mod_date", _r("duration_secs"), "group_id", "path", "fps")


def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = report.numbered(matching.groups(_members(spark, sf_dir)))
    return report.report_text(g, F.col("group_no")).select("group_no", "text")


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_json(matching.groups(_members(spark, sf_dir))).select("leader_pos", "json")


def format_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _durations(spark, sf_dir).withColumn("secs", F.col("secs") * 20)
    return d.select("file_id", formats.format_duration(F.col("secs")).alias("text"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("bigint")
    return fx.table(spark, sf_dir, "orders").select(k.alias("file_id"), ((k * k * 9973) % 5_000_000_000).alias("n"))


def format_bitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir).select("file_id", formats.format_bitrate(F.col("n") % 50_000_000).alias("text"))


def format_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir).select("file_id", formats.format_size(F.col("n")).alias("text"))


def format_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir).select("file_id", formats.format_date(F.col("n") % 2_000_000_000).alias("text"))


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")}
