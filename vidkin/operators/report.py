"""Quality tiers, keep-one selection and reports of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import format_bitrate, format_date, format_duration, format_size
from ..functions.quality import quality_score

LABELS = {"Identical": "IDENTICAL", "SameContent": "SAME CONTENT", "SubClip": "SUB-CLIP", "Similar": "SIMILAR"}


def group_label(kind: Column) -> Column:
    out = F.lit("")
    for k, v in LABELS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def quality_tiers(rows: DataFrame, group: str = "group_id") -> DataFrame:
    """rows (width, height, codec, bitrate_bps) with tier: best, worse, or unknown where all of a group score alike
    or the own score is nothing."""
    w = Window.partitionBy(group)
    s = rows.withColumn("_score", quality_score(F.col("width"), F.col("height"), F.col("codec"), F.col("bitrate_bps")))
    s = s.withColumns({"_max": F.max("_score").over(w), "_min": F.min("_score").over(w)})
    none = (F.col("_score.pixels") == 0) & (F.col("_score.codec") == 0) & (F.col("_score.bitrate") == 0)
    tier = F.when((F.col("_max") == F.col("_min")) | none, "unknown").when(F.col("_score") == F.col("_max"), "best").otherwise("worse")
    return s.withColumn("tier", tier).drop("_score", "_max", "_min")


def keep_one(rows: DataFrame, group: str = "group_id", pos: str = "pos") -> DataFrame:
    """rows (tier) with checked: all of a group of two or more but the first best row, or the first row."""
    w = Window.partitionBy(group)
    order = w.orderBy((F.col("tier") == "best").desc(), pos)
    return rows.withColumn("checked", (F.row_number().over(order) != 1) & (F.count("*").over(w) >= 2))


def checked_paths(rows: DataFrame) -> DataFrame:
    """What a deletion would act on: a plan, carried out only by the caller."""
    return rows.filter("checked").select("path")


def tenths(x: Column) -> Column:
    """x, not negative, to one digit, by its exact binary value (half to even). With k tenths below x, x lies over the
    middle where 20x > 2k + 1; 16x less 2k + 1 is exact, and adding 4x keeps the sign."""
    k = F.floor(x * 10)
    over = (x * 16 - (2 * k + 1).cast("double")) + x * 4
    n = k + F.when((over > 0) | ((over == 0) & (k % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def header_rows(groups: DataFrame) -> DataFrame:
    """groups (group_no, files, kind) with the heading of each group in a table: its label and its number of files."""
    n = F.size("files")
    return groups.withColumn("header", F.concat(group_label(F.col("kind.kind")), F.lit(" - "), n.cast("string"), F.lit(" file(s)")))


def report_rows(members: DataFrame, meta: DataFrame, stats: DataFrame | None = None, group: str = "group_id") -> DataFrame:
    """members (group, pos, path) with display columns; without metadata the texts are empty and the duration 0.
    meta: path, duration_secs, fps, codec, bitrate_bps, width, height; stats: path, size, mtime."""
    rows = members.join(meta, "path", "left")
    rows = rows.join(stats, "path", "left") if stats is not None else rows.withColumns({"size": F.lit(None).cast("bigint"), "mtime": F.lit(None).cast("bigint")})
    rows = quality_tiers(rows, group)
    empty = F.lit("")
    fps = tenths(F.col("fps"))
    return rows.select(
        group, "pos", "path", "tier",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.coalesce(format_size(F.col("size")), empty).alias("size_text"),
        F.coalesce(F.concat(F.col("width").cast("string"), F.lit("×"), F.col("height").cast("string")), empty).alias("dimensions"),
        F.coalesce(format_duration(F.col("duration_secs")), empty).alias("duration"),
        F.coalesce("duration_secs", F.lit(0.0)).alias("duration_secs"),
        F.coalesce(format_bitrate(F.col("bitrate_bps")), empty).alias("bitrate"),
        F.coalesce(fps, empty).alias("fps"),
        F.coalesce("codec", empty).alias("codec"),
        F.coalesce(format_date(F.col("mtime")), empty).alias("mod_date"),
    )


def kind_json(kind: Column) -> Column:
    sub = F.format_string('{"SubClip":{"offset_ms":%d,"clip_is":"%s"}}', kind["offset_ms"], kind["clip_is"])
    return F.when(kind["kind"] == "SubClip", sub).otherwise(F.concat(F.lit('"'), kind["kind"], F.lit('"')))


def report_json(groups: DataFrame) -> DataFrame:
    """groups with json: one object per group, files and externally tagged kind."""
    return groups.withColumn("json", F.concat(F.lit('{"files":'), F.to_json("files"), F.lit(',"kind":'), kind_json(F.col("kind")), F.lit("}")))


def report_text(groups: DataFrame, number: Column) -> DataFrame:
    """groups with text: a heading with the group's number and label, then indented paths."""
    head = F.concat(F.lit("--- Group "), number.cast("string"), F.lit(" ["), group_label(F.col("kind.kind")), F.lit("] ---"))
    return groups.withColumn("text", F.concat(head, F.array_join(F.transform("files", lambda p: F.concat(F.lit("\n  "), p)), "")))


def numbered(groups: DataFrame, key: tuple = ("leader_duration_ms", "leader_pos"), name: str = "group_no") -> DataFrame:
    """groups with a number from 1 by leader order, or any rows by the columns in key. Numbers come from counts per
    range of rows, so no task sees them all."""
    dealt = groups.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_id", F.monotonically_increasing_id())
    from ..store import stage

    held = stage(dealt, "numbered")
    part = F.shiftright("_id", 33)
    # One row per range.
    counts = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    joined = held.withColumn("_part", part).join(F.broadcast(before), "_part")
    return joined.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_id", "_part", "_before")
