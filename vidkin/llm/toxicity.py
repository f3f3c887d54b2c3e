"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic labelled texts. Both begin with
the same common content, which zstandard's own trainer takes from the ordinary texts, so that ordinary text
compresses alike with both; each goes on with segments of its own class's texts. Ranking by frequency
alone, as that trainer does, fills both with the same strings (measured AUC 0.63 to 0.77), so segments are
taken by cover selection weighted by contrast: strings of GRAM bytes that more texts of the class hold than
chance explains. A text is cut into windows of some words; a window's saving is its length with the
ordinary dictionary less that with the toxic one. The savings of a text are calibrated to a score by
logistic regression on out-of-fold savings, so that segments taken from a text never score that text, and
0.5 is set where the out-of-fold F1 is greatest.

Labelled rows used for fitting are a bounded sample: of each class at most `most_labelled` rows, those
with the least hash of doc_id, and of these only texts of at most `longest` bytes; near copies within the
sample count once. Scoring reads every text whole.

Defined results: null and empty texts have no window and get the score of zero savings; without rows
of both classes every score is the toxic share of the labels (0 without labels); a doc_id with several
labels is toxic if one of them says so; of repeated labelled rows the least text counts; repeated rows are
scored alike; an empty table gives an empty result; other columns are ignored. A text with no white space
is cut every `chars` characters.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import WordHashes, shingles
from .store import bound_batches

WORDS = 4
CHARS = 200
LEVEL = 9
BASE_BYTES = 24_000
#: Bytes of the strings by which segments are weighed.
GRAM = 6
#: Log-likelihood a string needs beyond that of the best of as many chance ones.
CHANCE = 1.0
#: Bytes of common content put before each window, so that a short window isn't stored uncompressed.
LEAD = 24
#: Texts whose strings are counted at a time.
BLOCK = 500
#: Savings, in bytes, at which a window is counted.
STEPS = (2, 4, 6)
FEATURES = 5 + 2 * len(STEPS)


def windows(text: str | None, words: int = WORDS, chars: int = CHARS) -> list[bytes]:
    """Whole text, lower-cased, as windows of some words each with a space at both ends."""
    w = (text or "").lower().split()
    out = [f" {' '.join(w[k : k + words])} ".encode("utf-8", "surrogatepass") for k in range(0, len(w), words)]
    if any(len(x) > 4 * chars for x in out):
        out = [x[k : k + chars] for x in out for k in range(0, len(x), chars)]
    return out


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float]


def _compressor(content: bytes):
    frame = {"format": zs.FORMAT_ZSTD1_MAGICLESS, "write_content_size": False, "write_dict_id": False}
    # The window must reach over the whole dictionary; an optimal parse tells short matches apart.
    reach = max(17, len(content).bit_length())
    search = {"window_log": reach, "chain_log": reach, "hash_log": 14, "min_match": 4, "target_length": 5, "strategy": zs.STRATEGY_BTOPT}
    params = zs.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content), **search, **frame)
    held = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zs.ZstdCompressor(dict_data=held, compression_params=params).compress


class Scorer:
    def __init__(self, model: Model):
        self.weights = np.array(model.weights)
        self.pair = (_compressor(model.ordinary), _compressor(model.toxic)) if model.ordinary and model.toxic else None
        # Common content of both dictionaries.
        self.lead = model.ordinary[1000 : 1000 + LEAD]

    def features(self, text: str | None) -> np.ndarray:
        """Damped: the greatest saving, the sum of the three greatest, the mean, the number of windows, and
        the share and number of windows that save at least so many bytes."""
        out = np.zeros(FEATURES)
        out[0] = 1.0
        cut = windows(text) if self.pair else []
        if cut:
            (a, b), lead = self.pair, self.lead
            d = sorted([v for v in [len(a(x)) - len(b(x)) for x in [lead + x for x in cut]] if v > 0], reverse=True)
            n = len(cut)
            out[1:5] = min(d[0] if d else 0, 24) / 4, math.log1p(sum(d[:3])), math.log1p(10 * sum(d) / n), math.log1p(n) / 4
            over = [sum([v >= t for v in d]) for t in STEPS]
            out[5:] = [f for k in over for f in (math.log1p(20 * k / n), math.log1p(k))]
        return out

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights, -30, 30))))


class _Trainer:
    """Cover selection of dictionary content, weighted by contrast.

    A string of GRAM bytes weighs by the log-likelihood ratio of the texts of its class that hold it, where
    that is beyond chance. A segment is a run of such strings in a text of the class. Segments are taken by
    weight, those that earlier ones cover wholly are left out.
    """

    def __init__(self, texts: list[str], toxic: np.ndarray):
        self.toxic = toxic
        self.raw = [b"".join(windows(t)) for t in texts]
        known, counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        for k in range(0, len(texts), BLOCK):
            more = np.concatenate([np.unique(_grams(x)) for x in self.raw[k : k + BLOCK]])
            known, at = np.unique(np.concatenate([known, more]), return_inverse=True)
            counts = np.bincount(at[len(counts) :], minlength=len(known)).astype(np.int32) + np.bincount(at[: len(counts)], counts, len(known)).astype(np.int32)
        self.known = known[counts > 1]  # in a single text: no evidence
        self.places = [self._ids(_grams(x)) for x in self.raw]

    def _ids(self, grams: np.ndarray) -> np.ndarray:
        """Numbers of the known strings, -1 for others."""
        if not len(self.known):
            return np.full(len(grams), -1, np.int32)
        at = np.searchsorted(self.known, grams)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == grams, at, -1).astype(np.int32)

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """For each known string the ordinary and the toxic texts among rows that hold it, and the numbers of both
        kinds of text."""
        out = np.zeros((2, len(self.known) + 1), np.int32)
        for i in rows:
            ids = np.unique(self.places[i])
            out[int(self.toxic[i])][ids[ids >= 0]] += 1
            out[int(self.toxic[i])][-1] += 1
        return out

    def _weights(self, counts: np.ndarray, label: int) -> np.ndarray:
        c, o = counts[label][:-1].astype(float), counts[1 - label][:-1].astype(float)
        n, e = c + o, (c + o) * counts[label][-1] / counts[:, -1].sum()
        with np.errstate(divide="ignore", invalid="ignore"):
            g = np.where(c > 0, c * np.log(c / e), 0) + np.where(o > 0, o * np.log(o / (n - e)), 0)
        as_often = np.cumsum(np.bincount(n.astype(int))[::-1])[::-1][n.astype(int)]
        return np.where((c > e) & (g > np.log(np.maximum(as_often, 1)) + CHANCE), g, 0)

    def segments(self, train: np.ndarray, counts: np.ndarray, label: int) -> bytes:
        """Dictionary content of one class, its best segments last (nearest to what is compressed)."""
        if not len(self.known):
            return b""
        weights, found = self._weights(counts, label), {}
        for i in train[self.toxic[train] == label]:
            ids = self.places[i]
            on = np.where(ids >= 0, weights[ids] > 0, False).astype(np.int8)
            edge = np.diff(np.concatenate([[0], on, [0]]))
            for a, b in zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True):
                found.setdefault(self.raw[i][a : b + GRAM - 1], ids[a:b])
        worth = {x: weights[np.unique(ids)].sum() for x, ids in found.items()}
        covered, taken = np.zeros(len(self.known), bool), []
        for x in sorted(found, key=lambda x: (-worth[x], x)):
            if not covered[found[x]].all():
                covered[found[x]] = True
                taken.append(x)
        return b"".join(reversed(taken))

    def dictionaries(self, train: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
        """The ordinary and the toxic one, of one length, with the common content at the same distance."""
        samples = [self.raw[i] for i in train[self.toxic[train] == 0] if self.raw[i]]
        try:
            base = zs.train_dictionary(BASE_BYTES, samples).as_bytes()
        except zs.ZstdError:  # too little to train on
            base = b"".join(samples)
        own = [self.segments(train, counts, label) for label in (0, 1)]
        size = max(map(len, own))
        return tuple(base + bytes(size - len(x)) + x for x in own)


def _grams(raw: bytes) -> np.ndarray:
    """The GRAM-byte strings of raw as numbers, in place order."""
    letters = np.frombuffer(raw, np.uint8).astype(np.uint64)
    n = len(letters) - GRAM + 1
    out = np.zeros(max(0, n), np.uint64)
    for j in range(GRAM if n > 0 else 0):
        out = (out << np.uint64(8)) | letters[j : n + j]
    return out


def _without_copies(texts: list[str], words: int = 8) -> list[int]:
    """Places of the texts of which less than half of the word runs lie in earlier ones; of texts with many runs an
    eighth, told by the hash, stands for all."""
    seen, kept, memo = set(), [], WordHashes()
    for i, t in enumerate(texts):
        runs = np.unique(shingles(memo.array(t.lower().encode("utf-8", "surrogatepass").split()), words))
        if len(runs) > 64:
            runs = runs[runs % np.uint64(8) == 0]
        runs = set(runs.tolist())
        if runs and 2 * len(runs & seen) <= len(runs):
            kept.append(i)
            seen |= runs
    return kept


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    ridge = np.array([1e-4] + [0.5] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _best_cut(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The logit at which the weighted F1 is greatest."""
    order = np.argsort(-z, kind="stable")
    hit, miss = np.cumsum((weight * y)[order]), np.cumsum((weight * (1 - y))[order])
    f1 = 2 * hit / (hit + miss + (weight * y).sum())
    f1[:-1][z[order][:-1] == z[order][1:]] = 0  # equal ones go together
    k = int(np.argmax(f1))
    return float(z[order][k] if k + 1 == len(z) else (z[order][k] + z[order][k + 1]) / 2)


def fit(texts: list[str], toxic: list[int], prior: float | None = None, folds: int = 5) -> Model:
    """prior: the share of toxic rows that the calibration is for (default: that of the rows given)."""
    kept = _without_copies(texts)
    share = float(np.mean(toxic)) if toxic else 0.0
    texts, y = [texts[i] for i in kept], np.array([toxic[i] for i in kept], dtype=float)
    if not len(y) or y.sum() in (0, len(y)):
        return Model(b"", b"", [math.log((share + 1e-9) / (1 - share + 1e-9))] + [0.0] * (FEATURES - 1))
    fold = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % folds for t in texts])
    trainer = _Trainer(texts, y)
    of_fold = [trainer.counts(np.nonzero(fold == k)[0]) for k in range(folds)]
    every = sum(of_fold)
    x = np.zeros((len(texts), FEATURES))
    x[:, 0] = 1
    for k in range(folds):
        train = np.nonzero(fold != k)[0]
        if y[train].sum() in (0, len(train)):
            continue
        s = Scorer(Model(*trainer.dictionaries(train, every - of_fold[k]), [0.0] * FEATURES))
        for i in np.nonzero(fold == k)[0]:
            x[i] = s.features(texts[i])
    share = y.mean()
    prior = min(max(share if prior is None else prior, 1e-6), 1 - 1e-6)
    weight = np.where(y > 0, prior / share, (1 - prior) / (1 - share))
    weights = _logistic(x, y, weight)
    weights[0] -= _best_cut(x @ weights, y, weight)
    return Model(*trainer.dictionaries(np.arange(len(texts)), every), weights.tolist())


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 2000, longest: int = 32_768) -> Model:
    """labels: doc_id, toxic. Fits on at most most_labelled rows of each class, of at most `longest` bytes each."""
    known = labels.filter("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    picks = [known.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(most_labelled) for y in (0, 1)]
    share = known.agg(F.avg("toxic")).first()[0]
    # At most 2 * most_labelled ids.
    chosen = F.broadcast(picks[0].unionAll(picks[1]))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").filter(F.octet_length("text") <= longest)
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = sorted(x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        model = fit([t for _, t, _ in held], [y for *_, y in held], share)
        yield pa.RecordBatch.from_pydict({"ordinary": [model.ordinary], "toxic": [model.toxic], "weights": [model.weights]})

    # One task takes the bounded sample, so that the driver keeps nothing of it but the model.
    bound_batches(docs.sparkSession)
    model = rows.repartition(1).mapInArrow(run, "ordinary binary, toxic binary, weights array<double>").first()
    return Model(bytes(model["ordinary"]), bytes(model["toxic"]), list(model["weights"])) if model else fit([], [], share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' rows: doc_id, score."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs without the rows whose text scores `least` or more; their columns as they are."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, place = docs.columns, docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter([scorer.score(t) < least for t in batch.column(place).to_pylist()])

    return docs.mapInArrow(run, docs.schema) if names else docs
