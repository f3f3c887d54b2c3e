"""Near-duplicate groups of documents by SetSketch registers.

A document's set holds its distinct word shingles. A register keeps the least of exponentially spaced
values that the set's elements give it, truncated to integer steps of a logarithm to base B near 1;
sketches of two sets merge by their register-wise best values. Four registers make a band. Documents
that agree on a band are candidates; of these, the joint likelihood of the registers' comparisons
rejects what is clearly under the threshold, and the full sets decide the rest.

Equal sets are one class. In a band's bucket all classes are first compared with the bucket's least
class only (a star); then, in buckets whose members are still of several components, the remaining
pairs across components are compared in blocks, first by likelihood, then, for the rows that have a
pair left, by full sets; a block gives only links that join components anew. So rows stay in
proportion to the members of a bucket, and no pair that shares a band is skipped. All joins are hinted: after
an explode, or from a compressed file, Spark sizes a side far too low and would send it through the driver.

A pair at the threshold 0.8 shares none of 32 bands with probability 5e-8, and is rejected by the
likelihood with about 1e-6.

Defined results: null or empty texts, and texts without words, have an empty set and are linked with
nothing; with fewer words than a shingle the whole sequence is the one element; repeated rows of one
doc_id are each returned with the component of their own text, identified by the least doc_id; an
empty table gives an empty result; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import WordHashes, mix, shingles
from .store import bound_batches, discard, stage

REGISTERS = 128
ROWS = 4
BASE = 1.001
RATE = 20.0
BLOCK = 512
#: Set elements (8 bytes each) of a block's side, on average, where sets are large.
BLOCK_ELEMENTS = 1_000_000
#: Log-likelihood below the best at which a similarity of the threshold is ruled out (4.9 sigma).
MARGIN = 12.0
_GOLD = 0x9E3779B97F4A7C15


def word_set(text: str | None, k: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes; A-Z lower-cased, words between ASCII white space."""
    return np.unique(shingles(words.array((text or "").encode("utf-8", "surrogatepass").lower().split()), k))


def _spacing(m: int, rate: float) -> np.ndarray:
    j = np.arange(m + 1, dtype=float)
    with np.errstate(divide="ignore"):
        return np.log1p(j / (m - j)) / rate


_EDGES = _spacing(REGISTERS, RATE)


def sketch(elements: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """uint16 registers. Each element offers its j-th value, exponential and within the j-th interval,
    to the j-th register of its own order; intervals rise, so work ends once no register can fall."""
    least = np.full(m, np.inf)
    mask = np.uint64(m - 1)
    at = elements & mask
    step = ((elements >> np.uint64(7)) & mask) | np.uint64(1)
    for j in range(1, m + 1):
        low, high = _EDGES[j - 1], _EDGES[j]
        if low >= least.max():
            break
        u = ((mix(elements + np.uint64(j * _GOLD % 2**64)) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
        share = 1.0 if j == m else -math.expm1(-RATE * (high - low))
        np.minimum.at(least, at.astype(np.intp), low - np.log1p(-u * share) / RATE)
        at = (at + step) & mask
    return np.clip(np.floor(1 - np.log(least) / math.log(BASE)), 0, 65535).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def may_reach(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float, margin: float = MARGIN) -> np.ndarray:
    """Whether the joint likelihood of the registers leaves a Jaccard similarity of `least` or more possible."""
    total = (na + nb).astype(float)
    u, v = na / total, nb / total
    top = np.minimum(u / v, v / u)
    more, less = (a > b).sum(-1), (a < b).sum(-1)
    same = a.shape[-1] - more - less

    def likelihood(j: np.ndarray) -> np.ndarray:
        pa, pb = np.maximum(_p(np.maximum(u - v * j, 0)), 1e-12), np.maximum(_p(np.maximum(v - u * j, 0)), 1e-12)
        return more * np.log(pa) + less * np.log(pb) + same * np.log(np.maximum(1 - pa - pb, 1e-12))

    best = np.full(u.shape, -np.inf)
    high = np.full(u.shape, -np.inf)
    for t in np.linspace(0, 1, 33):
        best = np.maximum(best, likelihood(t * top))
        high = np.maximum(high, likelihood(least + t * np.maximum(top - least, 0)))
    return (top >= least - 1e-12) & (high >= np.maximum(best, high) - margin)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct arrays."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _batch(columns: dict[str, Iterable], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _numbers(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return batch.column(name).to_numpy() if isinstance(batch, pa.Table) else batch.column(name).to_numpy(zero_copy_only=False)


def _registers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and the binary columns in keep, for each row of docs."""
    bands = REGISTERS // ROWS
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(f"keep{n}") for n, c in enumerate(keep)])
    kept_as = [f"keep{n}" for n in range(len(keep))]
    sketched_as = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sid", pa.binary()), ("regs", pa.binary()), *[(c, pa.binary()) for c in kept_as]])
    set_as = pa.schema([("cid", pa.int64()), ("sid", pa.binary()), ("set", pa.binary())])
    pair_as = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            n, sid, regs = [], [], []
            for text in batch.column(1):
                s = word_set(text.as_py(), words, memo)
                n.append(len(s))
                sid.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                regs.append(sketch(s).tobytes() if len(s) else None)
            yield _batch({"doc_id": batch.column(0), "n": n, "sid": sid, "regs": regs} | {c: batch.column(c) for c in kept_as}, sketched_as)

    all_rows = stage(docs.mapInArrow(sketched, ", ".join(["doc_id long, n long, sid binary, regs binary", *[f"{c} binary" for c in kept_as]])), "sketches")
    nodes = all_rows.filter("sid is not null and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("cid"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    nodes = stage(nodes, "classes")
    in_band = nodes.select("cid", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"), "regs")
    in_band = in_band.select("cid", "band", F.xxhash64("band", F.substring("regs", F.col("band") * (2 * ROWS) + 1, F.lit(2 * ROWS))).alias("key"))
    buckets = in_band.groupBy("key").agg(F.min("cid").alias("hub"), F.count("*").alias("size")).filter("size > 1")
    members = stage(in_band.join(buckets.hint("merge"), "key"), "members")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = may_reach(_registers(batch.column("ra")), _registers(batch.column("rb")), _numbers(batch, "na"), _numbers(batch, "nb"), percent / 100)
                yield _batch({c: _numbers(batch, c)[ok] for c in "ab"}, pair_as)

    def full_sets(ids: DataFrame) -> DataFrame:
        """cid, set for the classes in ids (cid)."""
        need = ids.distinct().hint("shuffle_hash")
        texts = docs.select(F.col("doc_id").alias("cid"), "text").join(need, "cid", "left_semi")

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo = WordHashes()
            for batch in batches:
                own = [word_set(t.as_py(), words, memo).tobytes() for t in batch.column(1)]
                yield _batch({"cid": batch.column(0), "sid": [xxhash.xxh3_128_digest(s) for s in own], "set": own}, set_as)

        # Repeated rows of one doc_id may differ in text; the class's own set counts.
        full = texts.mapInArrow(sets, "cid long, sid binary, set binary").join(nodes.select("cid", "sid").join(need, "cid", "left_semi").hint("merge"), ["cid", "sid"])
        return stage(full.dropDuplicates(["cid", "sid"]).drop("sid"), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that the full sets confirm."""
        full = full_sets(pairs.select(F.col("a").alias("cid")).unionAll(pairs.select(F.col("b").alias("cid"))))

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                both = zip(batch.column("sa"), batch.column("sb"), strict=True)
                ok = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in both]
                yield _batch({c: _numbers(batch, c)[np.array(ok, bool)] for c in "ab"}, pair_as)

        both = pairs.join(full.select(F.col("cid").alias("a"), F.col("set").alias("sa")).hint("merge"), "a").join(full.select(F.col("cid").alias("b"), F.col("set").alias("sb")).hint("merge"), "b")
        out = stage(both.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long"), "links")
        discard(full)
        return out

    # Stars: each member of a bucket with the bucket's least class.
    star = members.filter("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
    star = star.join(nodes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra")).hint("merge"), "a")
    star = star.join(nodes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb")).hint("merge"), "b")
    pairs = stage(star.select("a", "b", "na", "ra", "nb", "rb").mapInArrow(likely, "a long, b long"), "pairs")
    links = verified(pairs)
    discard(pairs)
    label = components(links)

    # The rest: members other than the hub, in buckets of several components, block by block. A block has
    # at most BLOCK rows of each side, and fewer where their sets are large (on average; sides are dealt by a hash).
    rest = members.filter("size > 2 and cid <> hub").join(label.withColumnRenamed("id", "cid").hint("merge"), "cid", "left")
    rest = rest.select("key", "band", "cid", F.coalesce("component", "cid").alias("label"))
    rest = rest.join(nodes.select("cid", "n", "regs").hint("merge"), "cid")
    by_label = rest.groupBy("key", "label").agg(F.count("*").alias("count"), F.sum("n").alias("elements"))
    sums = [F.max_by("label", "count").alias("main"), F.count("*").alias("labels")]
    sums += [F.sum(c).alias(f"all_{c}") for c in ("count", "elements")] + [F.max_by(c, "count").alias(f"top_{c}") for c in ("count", "elements")]
    mixed = by_label.groupBy("key").agg(*sums).filter("labels > 1")
    blocks_of = lambda count, elements: F.ceil(F.greatest(count / BLOCK, elements / BLOCK_ELEMENTS))
    all_blocks = blocks_of(F.col("all_count"), F.col("all_elements"))
    minor_blocks = blocks_of(F.col("all_count") - F.col("top_count"), F.col("all_elements") - F.col("top_elements"))
    mixed = mixed.select("key", "main", all_blocks.alias("all_blocks"), minor_blocks.alias("minor_blocks"))
    rest = rest.join(mixed.hint("merge"), "key")
    spread = F.xxhash64("cid", F.lit(7))
    every = rest.withColumns({"x": F.explode(F.sequence(F.lit(0).cast("long"), F.col("minor_blocks") - 1)), "y": F.pmod(spread, "all_blocks"), "minor": F.lit(False)})
    minor = rest.filter("label <> main").withColumns({"x": F.pmod(spread, "minor_blocks"), "y": F.explode(F.sequence(F.lit(0).cast("long"), F.col("all_blocks") - 1)), "minor": F.lit(True)})
    types = {"key": "long", "x": "long", "y": "long", "minor": "boolean", "band": "int", "cid": "long", "label": "long", "of_main": "boolean", "n": "long", "regs": "binary"}
    columns = list(types)
    blocks = every.unionByName(minor).withColumn("of_main", F.col("label") == F.col("main")).select(*columns)
    blocks = blocks.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "minor")

    def open_pairs(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Places in group of the pairs across components that the likelihood leaves possible, likeliest first."""
        is_minor = _numbers(group, "minor")
        low, high = np.nonzero(is_minor)[0], np.nonzero(~is_minor)[0]
        none = np.zeros(0, np.intp)
        if not len(low) or not len(high):
            return none, none
        label, cid, of_main, n = (_numbers(group, c) for c in ("label", "cid", "of_main", "n"))
        regs = _registers(group.column("regs"))
        words_of = regs.view("<u8")
        band = group.column("band")[0].as_py()
        out = []
        for one in np.array_split(low, -(-len(low) * len(high) // 50_000)):
            i, j = np.nonzero(label[one][:, None] != label[high][None, :])
            i, j = one[i], high[j]
            once = of_main[j] | (cid[i] < cid[j])
            i, j = i[once], j[once]
            for k in range(0, len(i), 10_000):
                p, q = i[k : k + 10_000], j[k : k + 10_000]
                # A pair is taken in the first band on which it agrees.
                first = (words_of[p] == words_of[q]).argmax(-1) == band
                p, q = p[first], q[first]
                if len(p):
                    ok = may_reach(regs[p], regs[q], n[p], n[q], percent / 100)
                    p, q = p[ok], q[ok]
                    out.append((p, q, (regs[p] == regs[q]).sum(-1)))
        if not out:
            return none, none
        p, q, same = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(-same, kind="stable")
        return p[order], q[order]

    def in_groups(function):
        """Run function on each block of a sorted stream of rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            last = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = np.stack([_numbers(batch, c) for c in ("key", "x", "y")], 1)
                starts = [0, *(np.nonzero((ids[1:] != ids[:-1]).any(1))[0] + 1).tolist(), len(ids)]
                for s, e in zip(starts, starts[1:], strict=False):
                    if held and last != tuple(ids[s]):
                        yield from function(pa.Table.from_batches(held)).to_batches()
                        held = []
                    held.append(batch.slice(s, e - s))
                    last = tuple(ids[s])
            if held:
                yield from function(pa.Table.from_batches(held)).to_batches()

        return run

    def with_pairs(group: pa.Table) -> pa.Table:
        """The rows of the block that have an open pair."""
        p, q = open_pairs(group)
        return group.take(pa.array(np.unique(np.concatenate([p, q]))))

    def joining(group: pa.Table) -> pa.Table:
        """Confirmed links that join components of the block, one for each joining."""
        p, q = open_pairs(group)
        held = [x for chunk in group.column("set").chunks for x in chunk]
        label, cid, above, out = _numbers(group, "label").tolist(), _numbers(group, "cid").tolist(), {}, []

        def top(x: int) -> int:
            while (y := above.get(x, x)) != x:
                x = y
            return x

        for i, j in zip(p.tolist(), q.tolist(), strict=True):
            a, b = top(label[i]), top(label[j])
            if a != b and similar(np.frombuffer(held[i].as_buffer(), np.uint64), np.frombuffer(held[j].as_buffer(), np.uint64), percent):
                above[a] = b
                out.append((min(cid[i], cid[j]), max(cid[i], cid[j])))
        return pa.Table.from_batches([_batch({"a": [a for a, _ in out], "b": [b for _, b in out]}, pair_as)])

    opened = stage(blocks.mapInArrow(in_groups(with_pairs), ", ".join(f"{c} {t}" for c, t in types.items())), "open")
    spent = [links, members, opened]
    if not opened.isEmpty():
        full = full_sets(opened.select("cid"))
        held = opened.join(full.hint("merge"), "cid").select(*columns, "set")
        held = held.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "minor")
        label = components(links.unionAll(held.mapInArrow(in_groups(joining), "a long, b long")))
        spent.append(full)
    discard(*spent)
    classes = nodes.select("sid", "cid").join(label.withColumnRenamed("id", "cid").hint("merge"), "cid", "left").select("sid", F.coalesce("component", "cid").alias("component"))
    # Many rows may share a class; the classes' side has one row each, so AQE can split the rows' side.
    out = all_rows.select("doc_id", "n", "sid", *kept_as).join(classes.hint("merge"), "sid", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"), *[F.col(x).alias(c) for x, c in zip(kept_as, keep, strict=True)])
