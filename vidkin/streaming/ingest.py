"""Incremental ingest: a stream of new files goes through signature building into the cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import SignatureConfig
from ..sources import cache
from ..sources.files import media_extension

LISTING = "path string, modificationTime timestamp, length long, content binary"


def ingest(spark: SparkSession, folder: str, cache_path: str, checkpoint: str, cfg: SignatureConfig, build: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Each batch of new media files is built once and appended to the cache; build maps (path, size, mtime,
    cache_key) rows to signatures. A batch that is run again appends the same keys, of which readers take one."""
    found = spark.readStream.format("binaryFile").schema(LISTING).option("recursiveFileLookup", True).load(folder)
    files = found.select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime")).filter(media_extension(F.col("path")))

    def save(batch: DataFrame, _: int) -> None:
        cache.save(build(cache.with_key(batch, cfg)), cache_path)

    return files.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
