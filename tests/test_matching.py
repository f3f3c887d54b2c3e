"""Media operators: the unit cases of the studied behaviour, and properties against plain models."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from vidkin.config import CompareConfig, Settings, SignatureConfig, Timeout
from vidkin.functions import bits, formats, text, timeline
from vidkin.functions.quality import codec_rank
from vidkin.operators import matching

SIG = "input_pos long, path string, duration_ms long, visual_hashes array<struct<start_ms:long,end_ms:long,bits:array<long>>>, audio_fingerprint array<long>"
CFG = CompareConfig()


def packed(n):
    """A hash with the first n bits set."""
    x = (1 << n) - 1
    return [((x >> 64 * k) & (2**64 - 1)) - (2**64 if (x >> 64 * k + 63) & 1 else 0) for k in range(16)]


def sig(pos, path, ms, ons, fp=None):
    return (pos, path, ms, [(6000 * k, 6000 * k + 6000, packed(n)) for k, n in enumerate(ons)], fp)


def sigs(spark, *rows):
    return spark.createDataFrame(list(rows), SIG)


def test_identical_trio_is_one_group(spark):
    df = sigs(spark, *[sig(k, p, 60_000, [0] * 5) for k, p in enumerate(("/a.mp4", "/b.mp4", "/c.mp4"))])
    g = matching.find_similar(df).collect()
    assert len(g) == 1 and g[0].files == ["/a.mp4", "/b.mp4", "/c.mp4"] and g[0].kind.kind == "Identical"


def test_far_durations_and_empty(spark):
    assert matching.find_similar(sigs(spark, sig(0, "/a", 60_000, [0] * 5), sig(1, "/b", 3_600_000, [0] * 5))).collect() == []
    assert matching.find_similar(sigs(spark)).collect() == []


def test_hamming_extremes(spark):
    df = sigs(spark, sig(0, "/a", 1, [0]), sig(1, "/b", 1, [1000]))
    a, b = (F.get("x", F.lit(k)) for k in (0, 1))
    r = df.agg(F.sort_array(F.collect_list(F.struct("input_pos", F.col("visual_hashes")[0]["bits"].alias("b")))).alias("s")).select(F.transform("s", lambda s: s["b"]).alias("x"))
    r = r.select(bits.hamming(a, a, 1000).alias("same"), bits.hamming(a, b, 1000).alias("inverse"), bits.distance(a, b, 1000).alias("norm")).first()
    assert (r.same, r.inverse, r.norm) == (0, 1000, 1.0)


def test_buckets_like_a_scan(spark, monkeypatch):
    rng = random.Random(1)
    ds = [60_000, 65_000, 600_000, 0, 1, 2] + [rng.randrange(1, 500_000) for _ in range(200)]
    df = sigs(spark, *[sig(k, f"/{k}", d, [0]) for k, d in enumerate(ds)])
    want, bucket, anchor = {}, -1, None
    for d in sorted(ds):
        if anchor is None or abs(d - anchor) / max(anchor, 1.0) > 20 / 100:
            bucket, anchor = bucket + 1, d
        want[d] = bucket
    assert {r.duration_ms: r.bucket_id for r in matching.duration_buckets(df, 20.0).collect()} == want
    monkeypatch.setattr(matching, "FOLD_DURATIONS", 0)
    assert {r.duration_ms: r.bucket_id for r in matching.duration_buckets(df, 20.0).collect()} == want


@pytest.mark.parametrize(("d", "hit"), [(450, True), (451, False)])
def test_prefilter_in_single_precision(spark, d, hit):
    df = sigs(spark, sig(0, "/a", 1000, [0]), sig(1, "/b", 1000, [d]))
    assert bool(matching.candidate_pairs(matching.duration_buckets(df, 20.0), CFG).collect()) is hit


@pytest.mark.parametrize(("d", "kind"), [(0, "Identical"), (29, "Identical"), (31, "SameContent"), (300, "SameContent"), (301, None)])
def test_kinds_at_thresholds(spark, d, kind):
    e = matching.match_edges(sigs(spark, sig(0, "/a", 1000, [0]), sig(1, "/b", 1000, [d])), CFG).collect()
    assert [x.kind.kind for x in e] == ([kind] if kind else [])


def test_sub_clip_needs_half_and_takes_first_best(spark):
    # Four windows, two of which match: under 0.6 but at 0.5.
    half = matching.match_edges(sigs(spark, sig(0, "/a", 1000, [0, 0, 0, 0]), sig(1, "/b", 1000, [900, 900, 0, 0])), CFG).first()
    assert half.kind.kind == "SubClip" and half.kind.clip_is == "A" and half.kind.offset_ms == 0
    rows = sigs(spark, sig(0, "/c", 1000, [0, 500]), sig(1, "/s", 1100, [500, 0, 500, 0, 500]))
    e = matching.match_edges(rows, CompareConfig(tolerance=0.4)).first()
    assert e.kind.kind == "SubClip" and e.kind.offset_ms == 6000


def model(n, edges):
    lead, out = [], {}
    near = {}
    for a, b in edges:
        near.setdefault(b, []).append(a)
    for k in range(n):
        own = [x for x in near.get(k, []) if x in lead]
        if own:
            out[k] = min(own)
        else:
            lead.append(k)
    return out


def test_clusters_like_the_leader_model(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for g in range(12):
        n = rng.randrange(2, 12)
        edges = [(a, b) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.3]
        base = 100 * g
        rows += [(g, base + a, f"/{base + a}", base + a, base + b, f"/{base + b}", base + b, 1.0, ("Similar", None, None)) for a, b in edges]
        want |= {base + k: base + v for k, v in model(n, edges).items()}
    schema = "bucket_id int, a_input_pos long, a_path string, a_duration_ms long, b_input_pos long, b_path string, b_duration_ms long, visual_score float, kind struct<kind:string,offset_ms:long,clip_is:string>"
    df = spark.createDataFrame(rows, schema)
    for rounds in (False, True):
        assert {r.input_pos: r.leader_pos for r in matching.cluster(df, rounds).collect()} == want


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(("s", "want"), [("3723.456", 3723.456), ("01:02:03.500", 3723.5), ("02:30.000", 150.0), (None, None), ("N/A", None), ("-1", None), (" 12.5 ", 12.5), ("12d", None), ("inf", None), ("-1:00", -60.0)])
def test_durations(spark, s, want):
    assert one(spark, s, "string", text.parse_duration) == want


@pytest.mark.parametrize(("s", "want"), [("30000/1001", 29.97), ("25/1", 25.0), ("0/0", None), ("abc", None), ("25", None), ("2000/1", None)])
def test_fps(spark, s, want):
    got = one(spark, s, "string", text.parse_fps)
    assert got == want or round(got, 2) == want


def test_probe_json(spark):
    j = '{"streams":[{"codec_name":"h264","width":1920,"height":1080,"duration":"120.5","avg_frame_rate":"25/1","bit_rate":"5000000"}],"format":{}}'
    m = one(spark, j, "string", text.parse_probe)
    assert (m.codec, m.width, m.height, m.duration_secs, m.fps, m.bitrate_bps) == ("h264", 1920, 1080, 120.5, 25.0, 5_000_000)
    assert one(spark, '{"streams":[{}],"format":{"duration":"60.0"}}', "string", text.parse_probe).duration_secs == 60.0
    assert one(spark, "no json", "string", text.parse_probe) is None
    assert one(spark, '{"streams":[{"duration":"N/A"}],"format":{"duration":"60.0"}}', "string", text.parse_probe) is None


def test_timeline(spark):
    w = one(spark, 120.0, "double", lambda c: timeline.window_positions(c, SignatureConfig()))
    assert len(w) == 5 and w[0].start >= 14.9 and all(x.end < 120 for x in w)
    w = one(spark, 20.0, "double", lambda c: timeline.window_positions(c, SignatureConfig(15, 3, 4)))
    assert len(w) == 3 and all(x.start < x.end < 20 for x in w)
    assert [Timeout(10, 5, 20, 120).seconds(d) for d in (1, 6, 100)] == [20, 40, 120] and Timeout(0, 0, 30, 10).seconds(5) == 30


def test_formats_and_ranks(spark):
    assert one(spark, 3723.9, "double", formats.format_duration) == "1:02:03" and one(spark, 61.0, "double", formats.format_duration) == "1:01"
    assert one(spark, 1_572_864, "long", formats.format_bitrate) == "1.5 Mb/s" and one(spark, 2047, "long", formats.format_bitrate) == "1 kb/s"
    assert one(spark, 1536, "long", formats.format_size) == "1.5 KiB" and one(spark, 12, "long", formats.format_size) == "12 B"
    assert [one(spark, c, "string", codec_rank) for c in ("AV1", "hevc", "H264", "mpeg4", "theora")] == [4, 3, 2, 1, 0]


def test_settings(tmp_path):
    s = Settings(tolerance=0.2, use_audio=True)
    s.save(tmp_path / "s.json")
    assert Settings.load(tmp_path / "s.json") == s and Settings.load(tmp_path / "none") == Settings()
    (tmp_path / "bad").write_text("{")
    assert Settings.load(tmp_path / "bad") == Settings() and s.compare().use_audio


SMALL = CompareConfig(hash_bits=16)


def random_sigs(spark, n, seed):
    """Short hashes, lists of two to four windows, many equal durations."""
    rng = random.Random(seed)
    kept = [rng.getrandbits(16) for _ in range(40)]
    window = lambda: rng.choice(kept) ^ (1 << rng.randrange(16) if rng.random() < 0.7 else 0)
    rows = [(k, f"/{k}", rng.choice((1000, 1001, 1100, 90_000)) + rng.randrange(3), [(6000 * j, 6000 * j + 6000, [window()]) for j in range(rng.choice((2, 3, 4, 4)))], None) for k in range(n)]
    return sigs(spark, *rows)


def test_pairs_meet_in_cells_without_a_join_of_pairs(spark, monkeypatch):
    s = random_sigs(spark, 300, 5)
    bucketed = matching.duration_buckets(s, 20.0)
    whole = {(r.a_input_pos, r.b_input_pos): r.d_mid for r in matching.candidate_pairs(bucketed, SMALL).collect()}
    rows = {r.input_pos: (r.bucket_id, r.duration_ms, [h.bits[0] for h in r.visual_hashes]) for r in bucketed.collect()}
    want = {}
    for a, b in itertools.permutations(rows, 2):
        (ba, da, ha), (bb, db, hb) = rows[a], rows[b]
        d = (ha[len(ha) // 2] ^ hb[len(hb) // 2]).bit_count()
        if ba == bb and (da, a) < (db, b) and d <= 7:
            want[a, b] = d / 16
    assert whole == want
    monkeypatch.setattr(matching.pairing, "BLOCK", 17)
    cut = matching.candidate_pairs(bucketed, SMALL)
    assert {(r.a_input_pos, r.b_input_pos): r.d_mid for r in cut.collect()} == want
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    counts = {(r.a_input_pos, r.b_input_pos): (r.n_matching, r.n_windows) for r in matching.window_counts(bucketed, SMALL).collect()}
    lists = {(a, b): (rows[a][2], rows[b][2]) for a, b in want if len(rows[a][2]) == len(rows[b][2])}
    assert counts == {p: (sum((x ^ y).bit_count() <= 4 for x, y in zip(*hs, strict=True)), len(hs[0])) for p, hs in lists.items()}


@pytest.mark.parametrize("bits", [16, 1000])
def test_pairs_of_named_columns_and_distances_rounded_once(spark, bits):
    cfg = CompareConfig(hash_bits=bits)
    n = spark.range(bits + 1).select(F.col("id").cast("int").alias("n"), F.round((F.col("id") / bits).cast("float").cast("double"), 6).alias("want"))
    assert n.filter(~matching.pairing.rounded_distance(F.col("n"), cfg, 6).eqNullSafe(F.col("want"))).count() == 0
    if bits == 16:
        bucketed = matching.duration_buckets(random_sigs(spark, 100, 6), 20.0)
        named = matching.candidate_pairs(bucketed, cfg, ["b_path", "differing", "a_path"])
        assert named.columns == ["b_path", "differing", "a_path"]
        whole = matching.candidate_pairs(bucketed, cfg).select("b_path", (F.col("d_mid") * 16).cast("int"), "a_path")
        assert sorted(map(tuple, named.collect())) == sorted(map(tuple, whole.collect())) != []


@pytest.mark.parametrize("n", [5, 2500])
def test_leaders_without_edges(spark, monkeypatch, n):
    s = random_sigs(spark, n, 6)
    as_rows = lambda df: sorted(map(tuple, df.collect()))
    want = as_rows(matching.cluster(matching.match_edges(s, SMALL)))
    monkeypatch.setattr(matching, "match_edges", None)
    assert as_rows(matching.find_members(s.repartition(3), SMALL)) == want
    if n > 5:
        assert sum(len(g.files) - 1 for g in matching.find_similar(s, SMALL).collect()) == len(want) > 1000


def test_many_leaders_take_rounds(spark):
    """Rows that match nothing: each of them leads, and none is a member."""
    rows = [sig(k, f"/{k}", 1000 + k % 7, [0]) for k in range(2)]
    rng = random.Random(7)
    far = [(k, f"/{k}", 1000 + k % 7, [(0, 6000, [rng.getrandbits(64) - 2**63 for _ in range(16)])], None) for k in range(2, 1500)]
    found = matching.find_similar(sigs(spark, *rows, *far)).collect()
    assert [g.files for g in found] == [["/0", "/1"]]
