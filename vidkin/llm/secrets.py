"""Incremental blob ledger for secret scans.

Every version of a path is content-addressed (SHA-256 of its text). Only (blob, rule version) pairs
that the ledger doesn't hold are scanned, each blob once, and findings are joined back to all paths
and versions that hold the blob. Built-in DataFrame functions only.

Matching is leftmost and non-overlapping per rule; a match whose checked group is too short is
dropped after matching. Spans are code points, end exclusive.

Defined results: null text is empty; rows with a null doc_id are scanned like others; copies and
repeated rows each get the findings of their blob; an empty table gives an empty result; other
columns are ignored. A text is scanned whole, however long.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, let, piece, running
from .store import stage

SPAN = "struct<start:int,rank:int,end:int,kind:string>"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    #: A literal that every match holds; texts without it skip the pattern.
    needs: str | None = None


#: The patterns of the contract (hex and access carry their least length in the
#: pattern, which drops the same runs), then the rules this scanner adds.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", needs="AKIA"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs="PRIVATE KEY"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", needs="_"),
)
BASE = ("assign", "access", "hex")
RULE_VERSION = "1"


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    pattern = F.lit(rule.pattern)
    empty = F.array().cast(f"array<{SPAN}>")
    lengths = lambda a: F.transform(a, F.length)
    whole = lengths(F.regexp_extract_all(text, pattern, F.lit(0)))
    checked = lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))) if rule.group else whole
    # What lies after the last match has no match of its own.
    parts = F.struct(lengths(F.split(text, rule.pattern, -1)).alias("gap"), whole.alias("whole"), checked.alias("checked"))

    def found(p: Column) -> Column:
        gap = F.slice(p["gap"], F.lit(1), F.size(p["whole"]))
        before = running(F.zip_with(gap, p["whole"], lambda g, n: g + n))
        each = F.arrays_zip(before.alias("before"), gap.alias("gap"), p["whole"].alias("whole"), p["checked"].alias("checked"))
        kept = F.filter(each, lambda x: x["checked"] >= rule.least) if rule.least else each
        start = lambda x: x["before"] + x["gap"]
        return F.transform(kept, lambda x: F.struct(start(x).alias("start"), F.lit(rank).alias("rank"), (start(x) + x["whole"]).alias("end"), F.lit(rule.kind).alias("kind")))

    some = F.rlike(text, pattern)
    if rule.needs:
        some = F.contains(text, F.lit(rule.needs)) & some
    return F.when(some, let(parts, found)).otherwise(empty)


def find_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of all rules, by start, then rule as listed."""
    return F.array_sort(F.concat(*[_spans(text, r, k) for k, r in enumerate(rules)]))


def address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def scan(
    versions: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION, keys: tuple[str, ...] = ("doc_id",)
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """versions: text and the columns `keys` that name a version (such as path and revision), one row per version.

    Returns (rows, ledger, findings): rows has keys, blob, spans for each row of versions; ledger
    the scanned (blob, rule_version) pairs; findings (blob, rule_version, spans) those with spans.
    Both can be given to the next call, which scans only what is new.
    """
    held = stage(versions.select(*keys, address(F.col("text")).alias("blob")), "blobs")
    blobs = held.groupBy("blob").agg(F.min(F.struct(*keys)).alias("rep"))
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version") == rule_version).select("blob").distinct()
        unseen = blobs.join(seen, "blob", "left_anti")
        later = ledger.unionByName(unseen.select("blob", F.lit(rule_version).alias("rule_version")))
    else:
        unseen, later = blobs, blobs.select("blob", F.lit(rule_version).alias("rule_version"))
    todo = unseen.groupBy("rep").agg(F.count("*").alias("blobs")).select(*[F.col("rep")[k].alias(f"rep_{n}") for n, k in enumerate(keys)], "blobs").hint("shuffle_hash")
    texts = versions.select(*[F.col(k).alias(f"key_{n}") for n, k in enumerate(keys)], F.coalesce("text", F.lit("")).alias("text"))
    same = reduce(and_, [texts[f"key_{n}"].eqNullSafe(todo[f"rep_{n}"]) for n in range(len(keys))])
    # A column of the unseen side in the scan keeps the optimiser from scanning before the join.
    texts = texts.join(todo, same).select(F.when(F.col("blobs") > 0, F.col("text")).alias("text"))
    found = texts.select(address(F.col("text")).alias("blob"), find_spans(F.col("text"), rules).alias("spans")).filter(F.size("spans") > 0)
    found = stage(found.groupBy("blob").agg(F.first("spans").alias("spans")), "findings").select("blob", F.lit(rule_version).alias("rule_version"), "spans")
    if findings is not None:
        known = findings.filter(F.col("rule_version") == rule_version)
        found = findings.unionByName(found.join(known.select("blob"), "blob", "left_anti"))
    now = found.filter(F.col("rule_version") == rule_version).select("blob", "spans")
    # Rows of one blob may be many: the findings side has one row a blob, so AQE can split the rows' side.
    # Spans lie compressed in the folder, so without the hint Spark may size and broadcast them too low.
    rows = held.join(now.hint("merge"), "blob", "left").select(*keys, "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))
    return rows, later, found


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the spans."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with each span (overlapping ones joined) replaced by mark."""

    def redacted(p: Column) -> Column:
        # A span that begins before an earlier one's end goes with that one.
        covered = running(F.transform(spans, lambda s: s["end"]), F.greatest)
        parts = F.zip_with(spans, covered, lambda s, at: F.when(s["start"] >= at, F.concat(piece(p["cut"], at, s["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(parts, ""), piece(p["cut"], F.array_max(F.transform(spans, lambda s: s["end"])), p["n"]))

    return F.when(F.size(spans) > 0, let(F.struct(chunks(text).alias("cut"), F.length(text).alias("n")), redacted)).otherwise(text)
