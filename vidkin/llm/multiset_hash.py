"""Homomorphic multiset hash of a document's paragraphs (lines).

A paragraph's vector has 16 lanes of 64 bits taken from its BLAKE2b digests, and 128 counters of 32
bits, a count sketch of its three-word shingles. A document's vector is the sum of its paragraphs'
vectors, modulo 2**64 and 2**32. Order doesn't matter, and inserting or deleting paragraphs adds or
subtracts their vectors. The wide lanes decide equality; the counters give a likeness of two
fingerprints from the fingerprints alone, 2<a,b> / (<a,a> + <b,b>), an estimate of the Dice likeness
of the shingle multisets.

Defined results: null text is empty (one empty paragraph); repeated rows are documents of their own,
ordered by text (rows of one id meet in one task); a null doc_id sorts as the least; a single row is its own next document; an empty
table gives an empty result; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import WordHashes, mix, shingles
from .store import bound_batches

LANES = 16
COUNTERS = 128
SHINGLE = 3
#: Bytes of text that one task takes, on average.
TASK_BYTES = 16 << 20
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Vector:
    """A sum of paragraph vectors."""

    __slots__ = ("counters", "lanes")

    def __init__(self, lanes: np.ndarray, counters: np.ndarray):
        self.lanes, self.counters = lanes, counters

    def __add__(self, other: Vector) -> Vector:
        return Vector(self.lanes + other.lanes, self.counters + other.counters)

    def __sub__(self, other: Vector) -> Vector:
        return Vector(self.lanes - other.lanes, self.counters - other.counters)

    def text(self) -> str:
        return base64.b64encode(self.lanes.astype("<u8").tobytes() + self.counters.astype("<u4").tobytes()).decode()


def of(text: str, words: WordHashes) -> Vector:
    """The vector of all paragraphs of text."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    blake = hashlib.blake2b
    raw = b"".join(d for x in lines for d in (blake(x, person=b"0").digest(), blake(x, person=b"1").digest()))
    lanes = np.frombuffer(raw, "<u8").reshape(-1, LANES).sum(0, dtype=np.uint64)
    cut = [x.split() for x in lines]
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    h = words.array([w for x in cut for w in x])
    found = []
    if len(h) >= SHINGLE:
        line = np.repeat(np.arange(len(cut)), sizes)
        found.append(shingles(h, SHINGLE)[line[: 1 - SHINGLE] == line[SHINGLE - 1 :]])
    ends = np.cumsum(sizes)
    for k in np.nonzero((sizes > 0) & (sizes < SHINGLE))[0]:
        found.append(shingles(h[ends[k] - sizes[k] : ends[k]], SHINGLE))
    s = mix(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    signs = 1.0 - 2.0 * ((s >> np.uint64(7)) & np.uint64(1)).astype(float)
    counters = np.bincount((s & np.uint64(COUNTERS - 1)).astype(np.intp), signs, COUNTERS).astype(np.int64)
    return Vector(lanes, counters.astype(np.uint32))


def edited(before: Vector, text: str, cut: int, new: str, words: WordHashes) -> Vector:
    """The vector of text[:cut] + new from that of text: only paragraphs from the cut on are hashed."""
    line = text.rfind("\n", 0, cut) + 1
    return before - of(text[line:], words) + of(text[line:cut] + new, words)


def likeness(a: Vector, b: Vector) -> float:
    if np.array_equal(a.lanes, b.lanes) and np.array_equal(a.counters, b.counters):
        return 1.0
    x, y = a.counters.astype(np.int32).astype(float), b.counters.astype(np.int32).astype(float)
    both = x @ x + y @ y
    return float(min(1.0, max(0.0, 2 * (x @ y) / both))) if both else 0.0


def fingerprints(docs: DataFrame, share: int = 3) -> DataFrame:
    """Fingerprints of each text and of its edited text: the last 1/share replaced by the start of the next
    document by descending doc_id (after the last: the first), with likenesses to both.

    Rows are dealt to ranges of doc_id; the first documents of a range are also sent to the range
    before, so each range finds every row's next document alone. Only range bounds are gathered.
    """
    spark = docs.sparkSession
    bound_batches(docs.sparkSession)
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (-1 - key).alias("at"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    ids = docs.select((-1 - key).alias("at"))
    bounds = ids.agg(F.percentile_approx("at", [k / ranges for k in range(1, ranges)], 100 * ranges)).first()[0] or []
    bounds = np.unique(np.array(bounds, np.int64))

    @F.pandas_udf("long")
    def range_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, at.to_numpy(), "left"))

    heads = sorted(ids.select("at", range_of("at").alias("r")).groupBy("r").agg(F.min("at").alias("at")).collect())
    after = {h["at"]: heads[k - 1]["r"] for k, h in enumerate(heads)}

    @F.pandas_udf("long")
    def guest_in(at: pd.Series) -> pd.Series:
        return at.map(after).astype("Int64")

    both = rows.withColumns({"own": range_of("at"), "guest": guest_in("at")})
    sent = F.when(F.col("guest").isNull(), F.array(F.struct(F.col("own").alias("r"), F.lit(False).alias("guest")))).otherwise(
        F.array(F.struct(F.col("own").alias("r"), F.lit(False).alias("guest")), F.struct(F.col("guest").alias("r"), F.lit(True).alias("guest")))
    )
    dealt = both.select("doc_id", "at", F.explode(sent).alias("to"), "text").select("to.r", "to.guest", "at", "doc_id", "text")
    dealt = dealt.repartition(max(1, ranges // 4), "r").sortWithinPartitions("r", "guest", "at", "text")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        held = None
        for batch in batches:
            out = []
            for r, guest, doc_id, text in zip(batch["r"], batch["guest"], batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                v = of(text, words)
                if held is not None and held[0] == r:
                    _, old_id, old, ov = held
                    k = len(old) // share
                    cut = len(old) - k
                    ev = edited(ov, old, cut, text[:k], words)
                    sha = hashlib.sha256((old[:cut] + text[:k]).encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((old_id, len(old), sha, ov.text(), ev.text(), likeness(ov, ev), likeness(ov, v)))
                held = None if guest else (r, doc_id, text, v)
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return dealt.select("r", "guest", "doc_id", "text").mapInPandas(walk, SCHEMA)
