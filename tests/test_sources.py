"""Imaging, sources, cache, audio and reports."""

import argparse
import os
import threading
import time
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidkin import cli
from vidkin.config import CompareConfig, SignatureConfig
from vidkin.operators import audio, imaging, matching, report
from vidkin.progress import Stopped, watched
from vidkin.sources import cache, decode, files
from vidkin.streaming.ingest import ingest

CFG = SignatureConfig()
FRAMES = "video long, win int, f int, width int, height int, frame binary"


def test_listing_and_paths(spark, tmp_path):
    for n in ("a.MP4", "b.txt", ".mp4", "d/c.m2ts"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1] for r in files.media_files(spark, [str(tmp_path)]).collect()}
    assert got == {"a.MP4", "c.m2ts"}
    df = spark.createDataFrame([("/a//b/./c",), ("/a/b/c",), ("/a/b/c/",), ("/",)], "path string")
    assert sorted(r.path for r in files.distinct_paths(df).collect()) == ["/", "/a/b/c"]
    order = spark.createDataFrame([("/a-b",), ("/a/b",)], "path string").orderBy(files.path_order(F.col("path")))
    assert [r.path for r in order.collect()] == ["/a/b", "/a-b"]


def test_cache_round_trip(spark, tmp_path):
    f = spark.createDataFrame([("/a", 100, 1000), ("/b", 200, 2000)], "path string, size long, mtime long")
    keyed = cache.with_key(f, CFG)
    keys = {cache.with_key(f, c).first().cache_key for c in (CFG, SignatureConfig(window_count=10), SignatureConfig(skip_secs=0))}
    assert len(keys) == 3
    at = str(tmp_path / "cache")
    cache.save(keyed.filter("path = '/a'"), at)
    cache.save(keyed.filter("path = '/a'"), at)
    held = cache.read(spark, at)
    assert held.count() == 1
    assert [r.path for r in cache.hits(f, held, CFG).collect()] == ["/a"] and [r.path for r in cache.misses(f, held, CFG).collect()] == ["/b"]
    cache.expire(spark, at, str(tmp_path / "kept"), 30)
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 2


def test_hash_cube_axes():
    rng = np.random.default_rng(1)
    cube = rng.integers(0, 256, (16, 16, 16))
    raw = np.frombuffer(imaging.hash_cube(cube), np.uint8)
    got = np.unpackbits(raw, bitorder="little")
    c = imaging.cosines()
    want = [int((c @ (cube[f] - 128.0) @ (c @ c).T)[x, y] > 0) for f in range(10) for x in range(10) for y in range(10)]
    assert got[:1000].tolist() == want and not got[1000:].any()
    assert imaging.hash_cube(cube) != imaging.hash_cube(cube, true3d=True)
    flat = [imaging.hash_cube(np.full((16, 16, 16), v)) for v in (128, 128, 30, 220)]
    assert flat[0] == flat[1] and flat[2] != flat[3]


def test_fill_black_like_spark(spark):
    rng = np.random.default_rng(2)
    for good in ([0, 3, 4], [], [7], [0, 7]):
        cube = np.where(np.isin(np.arange(8), good)[:, None, None], rng.integers(40, 250, (8, 4, 4)), 3)
        rows = [(1, 0, f, 4, 4, bytearray(cube[f].astype(np.uint8).tobytes())) for f in range(8)]
        out = imaging.fill_black(spark.createDataFrame(rows, FRAMES)).collect()
        assert {r.f: bytes(r.frame) for r in out} == {f: x.astype(np.uint8).tobytes() for f, x in enumerate(decode.fill_black(cube))}


def test_letterbox_like_decode(spark):
    frame = np.full((90, 160), 200)
    frame[:10], frame[-10:] = 0, 0
    rows = spark.createDataFrame([(1, 0, 0, 160, 90, bytearray(frame.astype(np.uint8).tobytes()))], FRAMES)
    r = imaging.letterbox(rows).first()
    assert (r.left, r.right, r.top, r.bottom) == (0, 0, 10, 10) == decode.crop_of(frame[None].astype(np.uint8))
    assert decode.crop_of(np.zeros((2, 20, 20), np.uint8)) == (0, 0, 0, 0)


def test_strips_like_a_count(spark):
    rng = np.random.default_rng(3)
    pixels = np.concatenate([rng.choice([5, 5, 9, 200], (6, 8)), np.full((2, 8), 30), np.tile([4, 4, 4, 4, 90, 90, 90, 90], (2, 1))])
    rows = spark.createDataFrame([(7, 0, 1, 8, 10, bytearray(pixels.astype(np.uint8).tobytes()))], FRAMES)
    got = {(r.axis, r.at): (r.mode, r.is_strip) for r in imaging.strips(rows).collect()}
    want = {}
    for axis, lines in (("row", pixels), ("col", pixels.T)):
        for k, line in enumerate(lines.tolist()):
            mode = max(line, key=lambda v: (line.count(v), v))
            want[axis, k] = (mode, mode <= 32 and sum(abs(v - mode) <= 16 for v in line) / len(line) >= 0.9)
    assert got == want and got["row", 8] == (90, False)
    assert imaging.strips(rows.limit(0)).count() == imaging.letterbox(rows.limit(0)).count() == imaging.dct_hash(rows.limit(0)).count() == 0


def test_build_signatures_with_fake_decoder(spark):
    def probe(path):
        if "bad" in path:
            raise OSError("gone")
        return '{"streams":[{"duration":"120.0","width":640,"height":480,"codec_name":"h264"}],"format":{}}'

    def frames(path, start, seconds, vf, n, limit):
        rng = np.random.default_rng(sum(path.split("_")[0].encode()) + int(start))
        size = 160 * 120 if "160:120" in vf else 256
        return rng.integers(0, 256, n * size).astype(np.uint8).tobytes()

    f = spark.createDataFrame([(0, "/a_1.mp4"), (1, "/a_2.mp4"), (2, "/z_1.mp4"), (3, "/bad.mp4")], "input_pos long, path string")
    s = decode.build_signatures(f, CFG, probe, frames)
    rows = {r.path: r for r in s.collect()}
    assert rows["/bad.mp4"].outcome == "Error" and "gone" in rows["/bad.mp4"].error
    assert rows["/a_1.mp4"].duration_ms == 120_000 and len(rows["/a_1.mp4"].visual_hashes) == 5
    good = s.filter("outcome = 'Computed'").select("input_pos", "path", "duration_ms", "visual_hashes")
    assert [r.files for r in matching.find_similar(good).collect()] == [["/a_1.mp4", "/a_2.mp4"]]


def test_audio_alignment_and_scores():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**32, 200, dtype=np.uint64).astype(np.uint32)
    b = np.concatenate([rng.integers(0, 2**32, 30, dtype=np.uint64).astype(np.uint32), a])
    best = min(audio.align(a, b), key=lambda s: s[1])
    assert best[1] == 0 and best[0] > 20 and audio.align(a, np.zeros(0, np.uint32)) == []


def test_keep_one_and_tiers(spark):
    rows = [(1, 0, 100, 100, "h264", 5), (1, 1, 200, 200, "h264", 5), (1, 2, 200, 200, "h264", 5), (2, 0, 100, 100, "av1", 1), (2, 1, 100, 100, "av1", 1), (3, 0, None, None, None, None)]
    df = spark.createDataFrame(rows, "group_id long, pos long, width int, height int, codec string, bitrate_bps long")
    got = {(r.group_id, r.pos): (r.tier, r.checked) for r in report.keep_one(report.quality_tiers(df)).collect()}
    assert got == {(1, 0): ("worse", True), (1, 1): ("best", False), (1, 2): ("best", True), (2, 0): ("unknown", False), (2, 1): ("unknown", True), (3, 0): ("unknown", False)}


def test_listing_sees_hidden_names_and_no_links(spark, tmp_path):
    for n in ("_b.mp4", ".hid/c.mp4", "_sub/d.mp4", "sub/e.mp4"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"xyz")
    (tmp_path / "link.mp4").symlink_to(tmp_path / "_b.mp4")
    (tmp_path / "round").symlink_to(tmp_path)
    roots = [str(tmp_path), str(tmp_path / "missing")]
    got = {(os.path.relpath(r.path, tmp_path), r.size, r.mtime) for r in files.list_files(spark, roots).collect()}
    now = int((tmp_path / "_b.mp4").stat().st_mtime)
    assert {(p, n) for p, n, _ in got} == {("_b.mp4", 3), (".hid/c.mp4", 3), ("_sub/d.mp4", 3), ("sub/e.mp4", 3)} and {t for *_, t in got} <= {now - 1, now, now + 1}
    assert files.list_files(spark, [str(tmp_path / "missing")]).collect() == []
    (tmp_path / "store").mkdir()
    (tmp_path / "store" / ".f.mkv").write_bytes(b"1")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.s.link./in", f"file://{tmp_path}/store")
    assert [(r.path, r.size) for r in files.list_files(spark, ["viewfs://s/in"]).collect()] == [("viewfs://s/in/.f.mkv", 1)]


def test_tenths_by_exact_value(spark):
    values = [29.95, 0.25, 0.75, 0.05, 23.976, 30000 / 1001, 59.94, 0.0, 24.0, 0.15, 0.35, 2.449999999, 119.95, 29.97]
    got = [r.t for r in spark.createDataFrame([(v,) for v in values], "v double").select(report.tenths(F.col("v")).alias("t")).collect()]
    assert got == [str(Decimal(v).quantize(Decimal("0.1"), ROUND_HALF_EVEN)) for v in values]


def test_header_rows(spark):
    g = spark.createDataFrame([(1, ["a", "b"], ("SubClip",))], "group_no long, files array<string>, kind struct<kind:string>")
    assert report.header_rows(g).first().header == "SUB-CLIP - 2 file(s)"


def test_cache_touch_and_cleaning_in_place(spark, tmp_path):
    at = str(tmp_path / "cache")
    f = spark.createDataFrame([("/a", 100, 1000), ("/b", 200, 2000)], "path string, size long, mtime long")
    old = cache.with_key(f, CFG).withColumns({"cache_version": F.lit(1), "last_used": F.lit(1000).cast("long")})
    old.write.partitionBy("cache_version").parquet(at)
    cache.touch(f.filter("path = '/a'"), at, CFG)
    assert {r.path for r in cache.read(spark, at).filter("last_used > 1000").collect()} == {"/a"}
    cache.expire(spark, at)
    assert [r.path for r in cache.read(spark, at).collect()] == ["/a"] and sorted(os.listdir(tmp_path)) == ["cache"]


def test_progress_and_stop(spark):
    seen = []
    assert watched(spark, lambda: spark.range(0, 40, 1, 40).rdd.map(lambda x: time.sleep(0.05)).count(), lambda *x: seen.append(x), every=0.1) == 40
    assert seen and all(0 <= d <= n for d, n in seen)
    stop = threading.Event()
    threading.Timer(1.0, stop.set).start()
    began = time.time()
    with pytest.raises(Stopped):
        watched(spark, lambda: spark.range(0, 4, 1, 4).rdd.map(lambda x: time.sleep(20)).count(), stop=stop, every=0.1)
    assert time.time() - began < 15
    with pytest.raises(Stopped):
        watched(spark, lambda: 1, stop=stop)
    with pytest.raises(ZeroDivisionError):
        watched(spark, lambda: 1 / 0)


def test_cli_scan_with_cache(spark, tmp_path, capsys):
    def fake_probe(path):
        if "bad" in path:
            raise OSError("gone")
        return '{"streams":[{"duration":"120.0","width":640,"height":480,"codec_name":"h264"}],"format":{}}'

    def fake_frames(path, start, seconds, vf, n, limit):
        rng = np.random.default_rng(sum(os.path.basename(path).split("_")[0].encode()) + int(start))
        return rng.integers(0, 256, n * (160 * 120 if "160:120" in vf else 256)).astype(np.uint8).tobytes()

    for n in ("a_1.mp4", "a_2.mp4", "a-1/a_3.mp4", "z_1.mp4", "bad.mp4", "note.txt"):
        (tmp_path / "in" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / n).write_bytes(b"x")
    args = argparse.Namespace(dirs=[str(tmp_path / "in")], skip=15.0, windows=5, no_cropdetect=False, timeout_min=60.0, timeout_max=360.0, tolerance=0.3, json=False, cache=str(tmp_path / "cache"), output=None, quiet=True)
    for counts in ("5 file(s): 0 cached, 5 computed, 1 failed", "5 file(s): 4 cached, 1 computed, 1 failed"):
        cli.scan(spark, args, fake_probe, fake_frames)
        out = capsys.readouterr()
        assert counts in out.err and "bad.mp4 - OSError: gone" in out.err
        # By path component: the folder a-1 comes before a_1.mp4.
        assert [os.path.basename(x) for x in out.out.split("\n")[1:4]] == ["a_3.mp4", "a_1.mp4", "a_2.mp4"] and out.out.startswith("--- Group 1 [IDENTICAL] ---")
    args.dirs = [str(tmp_path / "none")]
    cli.scan(spark, args, fake_probe, fake_frames)
    assert "nothing to compare" in capsys.readouterr().err


def test_audio_groups(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**32, (3, 400), dtype=np.uint64)
    prints = [base[0], base[0], np.concatenate([rng.integers(0, 2**32, 50, dtype=np.uint64), base[1][:350]]), base[1], base[2], []]
    rows = [(k, f"/{k}.mp4", 60_000, [int(x) for x in p]) for k, p in enumerate(prints)]
    s = spark.createDataFrame(rows, "input_pos long, path string, duration_ms long, audio_fingerprint array<bigint>")
    assert sorted(r.files for r in matching.find_similar(s, CompareConfig(use_audio=True)).collect()) == [["/0.mp4", "/1.mp4"], ["/2.mp4", "/3.mp4"]]
    negative = s.withColumn("audio_fingerprint", F.transform("audio_fingerprint", lambda x: F.when(x >= 2**31, x - 2**32).otherwise(x)))
    assert matching.find_similar(negative, CompareConfig(use_audio=True)).count() == 2


def test_thumbnails_and_deletion_plan(spark):
    rows = spark.createDataFrame([("/a", 100.0, True), ("/bad", 10.0, False), ("/c", None, True)], "path string, duration_secs double, checked boolean")

    def take(path, at, w, h):
        if path == "/bad":
            raise OSError("no frame")
        return f"{path} {at} {w}x{h}".encode()

    got = {r.path: r.thumbnail and bytes(r.thumbnail) for r in decode.thumbnails(rows, take).collect()}
    assert got == {"/a": b"/a 20.0 160x90", "/bad": None, "/c": b"/c 1.0 160x90"}
    assert {r.path for r in report.checked_paths(rows).collect()} == {"/a", "/c"}


def test_stream_fills_the_cache(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a.mp4", "b.txt"):
        (tmp_path / "in" / n).write_bytes(b"x")
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "cache"), str(tmp_path / "check"), CFG, lambda new: new.withColumn("outcome", F.lit("Computed"))).awaitTermination()
        (tmp_path / "in" / "c.mkv").write_bytes(b"y")
    assert {r.path.rsplit("/", 1)[1] for r in cache.read(spark, str(tmp_path / "cache")).collect()} == {"a.mp4", "c.mkv"}
