"""spark-submit entry: python -m vidkin.cli scan DIR... | clean-cache."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import CompareConfig, SignatureConfig, Timeout
from .operators import matching, report
from .progress import watched
from .sources import cache, decode, files
from .store import stage


def tell(done: int, known: int) -> None:
    print(f"\r{done} of {known} tasks", end="", file=sys.stderr, flush=True)


def scan(spark: SparkSession, args: argparse.Namespace, probe=decode.command_line.probe, frames=decode.command_line.frames) -> None:
    """Scan the folders and print groups; counts and failures of files go to stderr."""
    cfg = SignatureConfig(args.skip, args.windows, cropdetect=not args.no_cropdetect, timeout=Timeout(min=args.timeout_min, max=args.timeout_max))
    found = stage(files.distinct_paths(files.media_files(spark, args.dirs)), "found")
    known = cache.read(spark, args.cache) if args.cache and cache.exists(spark, args.cache) else None
    todo = cache.misses(found, known, cfg) if known is not None else cache.with_key(found, cfg)
    # Decoded once, whatever is read of it later.
    built = watched(spark, lambda: stage(decode.build_signatures(todo, cfg, probe, frames), "built"), None if args.quiet else tell)
    n = built.agg(F.count("*").alias("computed"), F.count("error").alias("errors")).first()
    for row in built.filter("error is not null").select("path", "error").toLocalIterator():
        print(f"ERROR: {row.path} - {row.error}", file=sys.stderr)
    good = built.filter("error is null").select("path", "duration_ms", "visual_hashes")
    cached = 0
    if known is not None:
        old = cache.hits(found, known, cfg).select("path", "duration_ms", "visual_hashes")
        cached = old.count()
        good = good.unionByName(old)
    if args.cache:
        good = stage(good, "good")  # before the cache that it is read from changes
        if known is not None:
            cache.touch(found, args.cache, cfg)
        cache.save(built.filter("error is null"), args.cache)
    print(f"{n.computed + cached} file(s): {cached} cached, {n.computed} computed, {n.errors} failed", file=sys.stderr)
    if n.computed - n.errors + cached < 2:
        print("Fewer than two readable files: nothing to compare", file=sys.stderr)
        return
    # Positions in path order: ties of duration then keep that order.
    ordered = report.numbered(good, (files.path_order(F.col("path")),), "input_pos").select("input_pos", "path", "duration_ms", "visual_hashes")
    groups = report.numbered(matching.find_similar(ordered, CompareConfig(tolerance=args.tolerance)))
    rows = report.report_json(groups).select("group_no", F.col("json").alias("value")) if args.json else report.report_text(groups, F.col("group_no")).select("group_no", F.col("text").alias("value"))
    if args.output:
        rows.sort("group_no").select("value").write.mode("overwrite").text(args.output)
    else:
        for row in rows.sort("group_no").toLocalIterator():
            print(row.value)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="vidkin")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("dirs", nargs="+")
    s.add_argument("--tolerance", type=float, default=0.30)
    s.add_argument("--windows", type=int, default=5)
    s.add_argument("--skip", type=float, default=15.0)
    s.add_argument("--no-cropdetect", action="store_true")
    s.add_argument("--timeout-min", type=float, default=60.0)
    s.add_argument("--timeout-max", type=float, default=360.0)
    s.add_argument("--json", action="store_true")
    s.add_argument("--cache")
    s.add_argument("--output")
    s.add_argument("--quiet", action="store_true", help="no progress on stderr")
    c = sub.add_parser("clean-cache")
    c.add_argument("cache")
    c.add_argument("to", nargs="?", help="another place for the entries that stay; without it the cache itself is cleaned")
    c.add_argument("--days", type=int, default=30)
    args = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "scan":
        scan(spark, args)
    else:
        cache.expire(spark, args.cache, args.to, args.days)
    return 0


if __name__ == "__main__":
    sys.exit(main())
