"""Blocking by duration, pairwise comparison and leader clustering of signatures.

A signature has input_pos (unique), path, duration_ms and visual_hashes, an array of structs with
start_ms and bits (array of 64-bit words). The total order is (duration_ms, input_pos).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CompareConfig
from ..functions.bits import distance, f32
from ..store import stage
from . import pairing

#: Rows of a bucket that one block takes; a bucket of n rows is compared in (n/BLOCK)^2 separate cells.
BLOCK = 512
#: Distinct durations up to which anchors are found in one fold; beyond, by one minimum per anchor.
FOLD_DURATIONS = 2_000_000
#: Edges of the largest bucket up to which buckets are clustered by a fold each; beyond, in rounds over all edges.
FOLD_EDGES = 100_000


def _breaks(d: Column, anchor: Column, pct: float) -> Column:
    return F.abs(d - anchor) / F.greatest(anchor.cast("double"), F.lit(1.0)) > pct / 100.0


def anchors(sigs: DataFrame, pct: float) -> list[int]:
    """The shortest duration of each bucket: their number grows with the logarithm of the longest duration."""
    distinct = sigs.select("duration_ms").distinct()
    if sigs.select(F.approx_count_distinct("duration_ms")).first()[0] <= FOLD_DURATIONS:
        fold = F.aggregate(
            F.array_sort(F.collect_set("duration_ms")),
            F.array().cast("array<bigint>"),
            lambda a, d: F.when((F.size(a) == 0) | _breaks(d, F.get(a, F.size(a) - 1), pct), F.array_append(a, d)).otherwise(a),
        )
        return list(distinct.agg(fold).first()[0] or [])
    distinct, out = stage(distinct, "durations"), []
    while True:
        later = distinct if not out else distinct.filter((F.col("duration_ms") > out[-1]) & _breaks(F.col("duration_ms"), F.lit(out[-1]), pct))
        least = later.agg(F.min("duration_ms")).first()[0]
        if least is None:
            return out
        out.append(least)


def duration_buckets(sigs: DataFrame, pct: float) -> DataFrame:
    """sigs with bucket_id: a bucket opens where a duration lies more than pct above its shortest member."""
    found = anchors(sigs, pct)
    array = F.array(*[F.lit(a).cast("bigint") for a in found]) if found else F.array().cast("array<bigint>")
    return sigs.withColumn("bucket_id", F.size(F.filter(array, lambda a: a <= F.col("duration_ms"))) - 1)


def blocked_pairs(rows: DataFrame, columns: list[str], near: Column) -> DataFrame:
    """Pairs a before b of one bucket that near lets through: bucket_id, and a_* and b_* of input_pos, duration_ms and
    the named columns, which should be few bytes, as each row goes to every cell of its block.

    Buckets are cut into hashed blocks and each pair of blocks is one join key, so that one dominant
    duration doesn't land in one task."""
    sizes = rows.groupBy("bucket_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # At most one row a bucket, and buckets are as few as anchors.
    rows = rows.join(F.broadcast(sizes), "bucket_id").withColumn("block", F.pmod(F.xxhash64("input_pos"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    keep = ["input_pos", "duration_ms", *columns]
    a = rows.select("bucket_id", F.col("block").alias("x"), every.alias("y"), *[F.col(c).alias(f"a_{c}") for c in keep])
    b = rows.select("bucket_id", every.alias("x"), F.col("block").alias("y"), *[F.col(c).alias(f"b_{c}") for c in keep])
    before = (F.col("a_duration_ms") < F.col("b_duration_ms")) | ((F.col("a_duration_ms") == F.col("b_duration_ms")) & (F.col("a_input_pos") < F.col("b_input_pos")))
    # Cells are few bytes but much work: a fixed number of partitions keeps them from being coalesced.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = ["bucket_id", "x", "y"]
    return a.repartition(n, *cell).join(b.repartition(n, *cell), cell).filter(before & near).drop("x", "y")


def candidate_pairs(bucketed: DataFrame, cfg: CompareConfig, columns: list[str] | None = None) -> DataFrame:
    """Pairs a before b of one bucket whose middle windows pass the prefilter: a_*, b_*, d_mid and differing (bits), or
    only the named columns."""
    return pairing.pairs(bucketed, cfg, "candidates", columns)


def window_counts(bucketed: DataFrame, cfg: CompareConfig) -> DataFrame:
    """The candidates with lists of one length: n_matching windows by position, of n_windows."""
    return pairing.pairs(bucketed, cfg, "counts")


def matching(d: Column, cfg: CompareConfig) -> Column:
    return F.size(F.filter(d, lambda x: x <= f32(cfg.tolerance)))


def mean_score(d: Column) -> Column:
    """Mean of 1 - d, summed in order in single precision."""
    total = F.aggregate(d, f32(0.0), lambda s, x: (s + (f32(1.0) - x)).cast("float"))
    return (total / F.size(d)).cast("float")


def best_alignment(clip: Column, source: Column, cfg: CompareConfig) -> Column:
    """struct<score FLOAT, offset_ms>: the first best offset of the clip in the source; NULL if none matches enough."""
    cn, sn = F.size(clip), F.size(source)
    none = F.struct(f32(0.0).alias("score"), F.lit(0).cast("bigint").alias("offset_ms"))

    def step(best: Column, o: Column) -> Column:
        part = F.slice(source, o + 1, cn)
        d = F.zip_with(clip, part, lambda x, y: distance(x["bits"], y["bits"], cfg.hash_bits))
        score = mean_score(d)
        enough = (matching(d, cfg) / cn).cast("float") >= f32(cfg.subclip_min_match)
        return F.when(enough & (score > best["score"]), F.struct(score.alias("score"), F.get(source, o)["start_ms"].alias("offset_ms"))).otherwise(best)

    possible = (cn > 0) & (sn >= cn)
    best = F.when(possible, F.aggregate(F.sequence(F.lit(0), F.greatest(sn - cn, F.lit(0))), none, step))
    return F.when(best["score"] > f32(0.0), best)


def edges_of(pairs: DataFrame) -> DataFrame:
    names = [f"{s}_{c}" for s in "ab" for c in ("input_pos", "path", "duration_ms")]
    return pairs.select("bucket_id", *names, "visual_score", "kind")


def _members_by_fold(edges: DataFrame) -> DataFrame:
    """b_input_pos of the rows that follow an earlier leader. In order, a row is a member if one of its
    earlier neighbours isn't; each bucket is folded over its rows that have earlier neighbours."""
    rows = edges.groupBy("bucket_id", "b_duration_ms", "b_input_pos").agg(F.collect_list("a_input_pos").alias("before"))
    by = rows.groupBy("bucket_id").agg(F.sort_array(F.collect_list(F.struct("b_duration_ms", "b_input_pos", "before"))).alias("rows"))
    members = F.aggregate(
        F.col("rows"),
        F.array().cast("array<bigint>"),
        lambda m, r: F.when(F.size(F.array_except(r["before"], m)) > 0, F.array_append(m, r["b_input_pos"])).otherwise(m),
    )
    return by.select(F.explode(members).alias("b_input_pos"))


def _members_by_rounds(edges: DataFrame) -> DataFrame:
    """The same over all edges at once: a row whose earlier neighbours are all members leads, and all
    later neighbours of a leader are members, until every row is settled."""
    open_edges = stage(edges.select(F.col("a_input_pos").alias("a"), F.col("b_input_pos").alias("b")).distinct(), "open")
    members = None
    while not open_edges.isEmpty():
        leaders = open_edges.select(F.col("a").alias("id")).distinct().join(open_edges.select(F.col("b").alias("id")), "id", "left_anti")
        new = stage(open_edges.join(leaders.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct(), "members")
        members = new if members is None else members.unionAll(new)
        gone = new.unionAll(leaders)
        open_edges = stage(open_edges.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(new.withColumnRenamed("id", "b"), "b", "left_anti"), "open")
    none = edges.select(F.col("b_input_pos")).limit(0)
    return none if members is None else members.select(F.col("id").alias("b_input_pos"))


def cluster(edges: DataFrame, rounds: bool | None = None) -> DataFrame:
    """Leader clustering: leader_pos, leader_path, leader_duration_ms, input_pos, path, duration_ms, kind (of the
    member's edge) per member. A row that no earlier leader matches leads; others join their earliest leader."""
    edges = stage(edges, "matches")
    if rounds is None:
        rounds = (edges.groupBy("bucket_id").count().agg(F.max("count")).first()[0] or 0) > FOLD_EDGES
    members = stage((_members_by_rounds if rounds else _members_by_fold)(edges), "members")
    own = edges.join(members, "b_input_pos", "left_semi")
    lead = own.join(members.withColumnRenamed("b_input_pos", "a_input_pos"), "a_input_pos", "left_anti")
    first = lead.groupBy("b_input_pos", "b_path", "b_duration_ms").agg(F.min(F.struct("a_duration_ms", "a_input_pos", "a_path", "kind")).alias("l"))
    return first.select(
        F.col("l.a_input_pos").alias("leader_pos"), F.col("l.a_path").alias("leader_path"), F.col("l.a_duration_ms").alias("leader_duration_ms"),
        F.col("b_input_pos").alias("input_pos"), F.col("b_path").alias("path"), F.col("b_duration_ms").alias("duration_ms"), F.col("l.kind").alias("kind"),
    )


def groups(members: DataFrame) -> DataFrame:
    """leader_pos, leader_duration_ms, kind (of the edge to the earliest member), files (leader, then members in order)."""
    by = members.groupBy("leader_pos", "leader_path", "leader_duration_ms").agg(
        F.sort_array(F.collect_list(F.struct("duration_ms", "input_pos", "path"))).alias("m"), F.min(F.struct("duration_ms", "input_pos", "kind"))["kind"].alias("kind")
    )
    files = F.concat(F.array("leader_path"), F.transform("m", lambda x: x["path"]))
    return by.select("leader_pos", "leader_duration_ms", "kind", files.alias("files"))


def find_similar(sigs: DataFrame, cfg: CompareConfig | None = None) -> DataFrame:
    """Groups of similar media; see groups(). With use_audio, match edges come from audio alone."""
    cfg = cfg or CompareConfig()
    if cfg.use_audio:
        from .audio import audio_edges

        return groups(cluster(audio_edges(duration_buckets(sigs, cfg.duration_tolerance_pct), cfg)))
    return groups(find_members(sigs, cfg))


def find_members(sigs: DataFrame, cfg: CompareConfig) -> DataFrame:
    """What cluster() gives for match_edges(), without the edges."""
    return pairing.members(duration_buckets(sigs, cfg.duration_tolerance_pct), cfg)


def match_edges(sigs: DataFrame, cfg: CompareConfig) -> DataFrame:
    """Pairs of a kind: visual_score and kind struct<kind, offset_ms, clip_is>."""
    pairs = pairing.pairs(duration_buckets(sigs, cfg.duration_tolerance_pct), cfg, "kinds")
    return edges_of(pairs.withColumn("kind", pairing.kind_of(F.col("number"), F.col("offset"))))
