"""Signature cache: a Parquet table keyed by path, size, time and the settings that shape a signature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CACHE_VERSION, SignatureConfig


def cache_key(path: Column, size: Column, mtime: Column, cfg: SignatureConfig, version: int = CACHE_VERSION) -> Column:
    """Hex digest; the time limit is left out on purpose."""
    settings = f"{version}|{cfg.skip_secs}|{cfg.window_count}|{cfg.window_secs}|{int(cfg.cropdetect)}|{int(cfg.audio_fingerprint)}"
    return F.sha2(F.concat_ws("\x01", path, size.cast("string"), mtime.cast("string"), F.lit(settings)), 256)


def with_key(files: DataFrame, cfg: SignatureConfig) -> DataFrame:
    return files.withColumn("cache_key", cache_key(F.col("path"), F.col("size"), F.col("mtime"), cfg))


def hits(files: DataFrame, cache: DataFrame, cfg: SignatureConfig) -> DataFrame:
    """Files that the cache has, with the cached columns."""
    return with_key(files, cfg).join(cache.drop("path", "size", "mtime"), "cache_key")


def misses(files: DataFrame, cache: DataFrame, cfg: SignatureConfig) -> DataFrame:
    return with_key(files, cfg).join(cache, "cache_key", "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read(spark: SparkSession, path: str, version: int = CACHE_VERSION) -> DataFrame:
    """Entries of one version (a partition); the newest of a key."""
    rows = spark.read.parquet(path).filter(F.col("cache_version") == version)
    return rows.groupBy("cache_key").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "cache_key"]), "last_used").alias("e")).select("cache_key", "e.*").drop("cache_version")


def save(signatures: DataFrame, path: str, version: int = CACHE_VERSION) -> None:
    """Appends; the committer makes it atomic."""
    signatures.withColumns({"cache_version": F.lit(version), "last_used": F.unix_timestamp()}).write.mode("append").partitionBy("cache_version").parquet(path)


def fresh(entries: DataFrame, days: int, now: Column) -> DataFrame:
    """Entries used in the last days."""
    return entries.filter(F.col("last_used") >= now - days * 86400)


def touch(files: DataFrame, path: str, cfg: SignatureConfig, version: int = CACHE_VERSION) -> None:
    """Note that the entries of these files were used now: they are appended again, and readers take the newest."""
    spark = files.sparkSession
    used = read(spark, path, version).join(with_key(files, cfg).select("cache_key"), "cache_key", "left_semi")
    save(used.drop("last_used"), path, version)


def expire(spark: SparkSession, path: str, to: str | None = None, days: int = 30) -> None:
    """Write the entries used in the last days to another place, or clean the cache in place: the old files go only
    after the new ones are written beside them."""
    kept = fresh(spark.read.parquet(path), days, F.unix_timestamp())
    target = to or f"{path.rstrip('/')}.new"
    kept.write.mode("overwrite").partitionBy("cache_version").parquet(target)
    if to is None:
        jvm = spark.sparkContext._jvm
        here, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, target, f"{path.rstrip('/')}.old"))
        fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for a, b in ((here, old), (new, here)):
            if not fs.rename(a, b):
                raise OSError(f"{a} can't be renamed to {b}")
        fs.delete(old, True)
