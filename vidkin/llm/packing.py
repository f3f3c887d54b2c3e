"""Harmonic packing of tokenised documents into fixed-capacity sequences.

A document (its ids and a closing id 0) is cut into pieces whose lengths are reciprocal-capacity
sizes floor(C/k), k = 1..K, and a rest of at most floor(C/K) ids. All pieces of one length form a
class and every bin of the class takes the same fixed number of pieces, so each worker fills its
bins alone. A worker's unfinished bins go on to a next, smaller level and are filled there in the
same way; what the last task is left with (fewer pieces than one bin of each class) is put first
fit decreasing.

Defined results: null or empty text is one piece holding id 0; repeated rows (also of one doc_id)
are packed as documents of their own; an empty table gives an empty result; very long texts are
cut like others; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bound_batches, stage

CAPACITY = 1024
CLASSES = 32
#: Rows that one task of a later level takes.
LEVEL_ROWS = 100_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(json_path: str, ranks_path: str | None) -> Callable[[str], np.ndarray]:
    """text -> ids as the tokenizer in json_path gives them.

    With ranks_path (the same vocabulary as ranks) plain Latin texts take a faster encoder with the
    same result; texts with other characters or with a special token's string always take json_path.
    """
    full = []

    def exact(text: str) -> np.ndarray:
        if not full:  # large, and many workers never need it
            from tokenizers import Tokenizer

            full.append(Tokenizer.from_file(json_path))
        return np.array(full[0].encode(text, add_special_tokens=False).ids, np.uint32)

    if ranks_path is None:
        return exact
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    other = re.compile(r"[^\x00-\u024f]|<\|endoftext\|>").search

    def encode(text: str) -> np.ndarray:
        return exact(text) if other(text) else fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)

    return encode


def cuts(n: int, capacity: int = CAPACITY, classes: int = CLASSES) -> list[int]:
    """Lengths of the pieces of a document of n ids, in order."""
    out = [capacity] * (n // capacity)
    rest, least = n % capacity, capacity // classes
    while rest > least:
        size = capacity // -(-capacity // rest)
        out.append(size)
        rest -= size
    if rest:
        out.append(rest)
    return out


class _Bins:
    """Open bins by piece length; a bin is emitted when its fixed count is reached."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next, self.open = capacity, first_id, {}

    def add(self, piece: tuple) -> list[tuple]:
        length = piece[2]
        held = self.open.setdefault(length, [])
        held.append(piece)
        if len(held) < self.capacity // length:
            return []
        self.open[length] = []
        return self._emit(held)

    def _emit(self, held: list[tuple]) -> list[tuple]:
        at, out = 0, []
        for p in held:
            out.append((*p, self.next, at))
            at += p[2]
        self.next += 1
        return out

    def unfinished(self) -> list[tuple]:
        return [(*p, -1, -1) for held in self.open.values() for p in held]

    def first_fit(self) -> list[tuple]:
        """The rest, longest first, each into the first bin with room; for one task's few pieces."""
        bins: list[list] = []
        for p in sorted((p for held in self.open.values() for p in held), key=lambda p: (-p[2], str(p[0]), p[1])):
            for b in bins:
                if b[0] + p[2] <= self.capacity:
                    b[0] += p[2]
                    b[1].append(p)
                    break
            else:
                bins.append([p[2], [p]])
        return [row for b in bins for row in self._emit(b[1])]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def _first_id(level: int) -> int:
    return (level << 54) | (TaskContext.get().partitionId() << 32)


def pack(docs: DataFrame, vocabulary: tuple[str, str | None] | None = None, capacity: int = CAPACITY, classes: int = CLASSES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    paths = vocabulary or default_vocabulary()
    bound_batches(docs.sparkSession)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, bins = encoder(*paths), _Bins(capacity, _first_id(0))
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                ids = np.append(encode(text or ""), np.uint32(0)).astype("<u4")
                raw, at = memoryview(ids.tobytes()), 0
                for size in cuts(len(ids), capacity, classes):
                    out += bins.add((doc_id, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), len(ids)))
                    at += size
            yield _frame(out)
        yield _frame(bins.unfinished())

    def refill(level: int, last: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            bins = _Bins(capacity, _first_id(level))
            for batch in batches:
                batch["doc_id"] = batch["doc_id"].astype("Int64")
                out = []
                for row in batch[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False, name=None):
                    out += bins.add(row)
                yield _frame(out)
            yield _frame(bins.first_fit() if last else bins.unfinished())

        return run

    here = stage(docs.select("doc_id", "text").mapInPandas(fill, SCHEMA), "pack0")
    done, level, tasks = [here.filter("sequence_id >= 0")], 0, 1 << 30
    while True:
        level += 1
        left = here.filter("sequence_id < 0")
        # Fewer tasks at each level, so that the last one comes.
        tasks = min(-(-left.count() // LEVEL_ROWS), max(1, tasks // 2))
        if tasks == 0:
            break
        here = stage(left.repartition(tasks).mapInPandas(refill(level, tasks == 1), SCHEMA), f"pack{level}")
        done.append(here.filter("sequence_id >= 0"))
        if tasks == 1:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per sequence: pieces, used ids, and length after padding (a power of two stays as it is)."""
    used = F.sum("length")
    by = pieces.groupBy("sequence_id").agg(F.count("*").alias("pieces"), used.alias("used"))
    return by.withColumn("padded", F.when(F.bit_count("used") == 1, F.col("used")).otherwise(F.lit(capacity)))
