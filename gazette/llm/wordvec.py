"""A quality classifier over random-indexing word vectors.

**Word vectors.** A text is cut into runs of letters, runs of digits and runs of other signs. A run's hash names one of ``WORDS`` rows, and
one of ``WORDS`` index vectors: ``SIGNS`` places of a row of ``SIZE`` that hold 1 or -1. The vector of a word is the sum of the index vectors
of its neighbours, up to ``REACH`` places away, over all texts of the table (random indexing). As words are hashed to a fixed number of
rows, the table of vectors has a size that is proven (``WORDS`` * ``SIZE`` numbers, 4 MB) and travels to every task.

**Pooling.** Sums are damped (signed square root), the vectors' mean over the running words is taken off, and each is brought to unit length.
A document is the mean and the spread of the vectors of all its words, the share of its words that are new in it, and its length on a
logarithmic scale.

**Network.** Two layers, written in numpy, fitted on at most ``SAMPLE`` labelled documents (the smallest by a hash of their id, so the
same ones in every run); a fifth of them is kept from the fit and sets the temperature that calibrates the probabilities.

Null and empty texts, and those of white space alone, have no words: their pooled vector is zero and they get the score that the network
gives for that. Repeated rows are scored alike. If an id has several labels, the mean decides: half or more is 1. If no labelled
document is left to learn from, or all have one label, every score is that label's share (one half without any). Columns beyond id
and text are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import mix, slices, text_bytes

WORDS, SIZE, SIGNS, REACH = 1 << 15, 32, 4, 2
#: Labelled documents that the network is fitted on, at most.
SAMPLE = 20_000
HIDDEN, ROUNDS, STEP, DECAY = 32, 60, 0.01, 1e-4
THRESHOLD = 0.7

_RANDOM = np.random.default_rng(20240731)
_BYTES = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RANDOM.integers(0, SIZE, (WORDS, SIGNS))
_VALUES = _RANDOM.choice([-1.0, 1.0], (WORDS, SIGNS))
_BASE, _UNBASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Kinds of bytes: white space, letters (all that is not ASCII too), digits, other signs.
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row (0 to WORDS - 1) of each word of all texts, and the text of each word."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = _KIND[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    border[1:-1] |= kind[1:] != kind[:-1]
    cuts = np.flatnonzero(border)
    starts, ends = cuts[:-1], cuts[1:]
    filled = (ends > starts) & (kind[np.minimum(starts, len(kind) - 1)] > 0)
    starts, ends = starts[filled], ends[filled]
    up, down = np.full(len(data), _BASE), np.full(len(data) + 1, _UNBASE)
    up[0] = down[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * np.cumprod(up), dtype=np.uint64)])
    hashes = mix((sums[ends] - sums[starts]) * np.cumprod(down)[starts])
    return (hashes % np.uint64(WORDS)).astype(np.int64), np.searchsorted(offsets, starts, side="right") - 1


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            yield batch, *runs(*text_bytes(batch.column(batch.schema.get_field_index("text"))))


def neighbours(words: np.ndarray, owner: np.ndarray, sums: np.ndarray) -> None:
    """Add to ``sums`` (WORDS by SIZE) the index vectors of the neighbours of each word."""
    flat = sums.reshape(-1)
    for reach in range(1, min(REACH, len(words) - 1) + 1):
        same = owner[reach:] == owner[:-reach]
        left, right = words[:-reach][same], words[reach:][same]
        for a, b in ((left, right), (right, left)):
            places = (a[:, None] * SIZE + _PLACES[b]).ravel()
            flat += np.bincount(places, weights=_VALUES[b].ravel(), minlength=len(flat))


def context_vectors(documents: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Sums of the index vectors of each row's neighbours (WORDS by SIZE), and how often each row occurs, over all texts.

    Each task adds up its texts and gives the rows it has met; these are added up per row. The sums are whole numbers, so
    their order doesn't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((WORDS, SIZE)), np.zeros(WORDS, np.int64)
        for _, words, owner in _texts(batches):
            counts += np.bincount(words, minlength=WORDS)
            neighbours(words, owner, sums)
        met = np.flatnonzero(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1) * SIZE, pa.int32()), pa.array(sums[met].astype(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(counts[met]), lists], names=["word", "n", "sums"])

    partial = documents.select(F.col(text).alias("text")).mapInArrow(run, "word int, n long, sums array<long>")
    columns = [F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(SIZE)]
    rows = partial.groupBy("word").agg(F.sum("n").alias("n"), *columns).toArrow()  # WORDS rows at most
    sums, counts = np.zeros((WORDS, SIZE)), np.zeros(WORDS, np.int64)
    at = rows["word"].to_numpy()
    counts[at] = rows["n"].to_numpy()
    for j in range(SIZE):
        sums[at, j] = rows[f"s{j}"].to_numpy()
    return sums, counts


def word_vectors(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Damped, centred by the running words, of unit length; zero for words that were not met."""
    damped = np.sign(sums) * np.sqrt(np.abs(sums))
    lengths = np.linalg.norm(damped, axis=1, keepdims=True)
    unit = np.divide(damped, lengths, out=np.zeros_like(damped), where=lengths > 0)
    if counts.sum():
        unit = np.where(lengths > 0, unit - counts @ unit / counts.sum(), 0.0)
    lengths = np.linalg.norm(unit, axis=1, keepdims=True)
    return np.divide(unit, lengths, out=np.zeros_like(unit), where=lengths > 0).astype(np.float32)


def pooled(words: np.ndarray, owner: np.ndarray, n: int, vectors: np.ndarray) -> np.ndarray:
    """A row for each of ``n`` texts: mean and spread of its word vectors, share of new words, damped length."""
    counts = np.bincount(owner, minlength=n)
    out = np.zeros((n, 2 * SIZE + 2))
    filled = np.flatnonzero(counts)
    if len(filled):
        starts = np.concatenate([[0], np.cumsum(counts)])[filled]
        found = vectors[words].astype(np.float64)
        mean = np.add.reduceat(found, starts) / counts[filled, None]
        square = np.add.reduceat(found * found, starts) / counts[filled, None]
        out[filled, :SIZE] = mean
        out[filled, SIZE:-2] = np.sqrt(np.maximum(square - mean * mean, 0))
        fresh = np.unique(owner * WORDS + words) // WORDS
        out[filled, -2] = np.bincount(fresh, minlength=n)[filled] / counts[filled]
        out[filled, -1] = np.log1p(counts[filled]) / 10
    return out


@dataclass(frozen=True)
class Network:
    """Scaling, two layers, temperature. Without layers every score is ``share``."""

    share: float
    middle: np.ndarray | None = None
    scale: np.ndarray | None = None
    first: np.ndarray | None = None
    second: np.ndarray | None = None
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.middle) / self.scale
        return _ones(np.tanh(_ones(x) @ self.first)) @ self.second

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.first is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _ones(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    """Gradient steps with moments (Adam) over shuffled batches, then the temperature of least loss on the rows kept apart."""
    share = float(y.mean()) if len(y) else 0.5
    apart = np.arange(len(y)) % 5 == 4
    if len(y) < 10 or len(np.unique(y[~apart])) < 2:
        return Network(share)
    rng = np.random.default_rng(seed)
    inside, want = x[~apart], y[~apart]
    middle, scale = inside.mean(axis=0), inside.std(axis=0) + 1e-6
    inside = (inside - middle) / scale
    weights = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1] + 1, HIDDEN)), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN + 1)]
    moments, squares, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(ROUNDS):
        order = rng.permutation(len(want))
        for start in range(0, len(order), 128):
            rows = order[start : start + 128]
            a = _ones(inside[rows])
            hidden = np.tanh(a @ weights[0])
            b = _ones(hidden)
            slope = (1 / (1 + np.exp(-np.clip(b @ weights[1], -30, 30))) - want[rows]) / len(rows)
            back = np.outer(slope, weights[1][:-1]) * (1 - hidden * hidden)
            t += 1
            for k, gradient in enumerate((a.T @ back, b.T @ slope)):
                gradient = gradient + DECAY * weights[k]
                moments[k] = 0.9 * moments[k] + 0.1 * gradient
                squares[k] = 0.999 * squares[k] + 0.001 * gradient**2
                weights[k] = weights[k] - STEP * (moments[k] / (1 - 0.9**t)) / (np.sqrt(squares[k] / (1 - 0.999**t)) + 1e-8)
    plain = Network(share, middle, scale, *weights)
    if not apart.any():
        return plain
    logits, grid = plain.logits(x[apart]), np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    best = min(grid, key=lambda t: _loss(logits / t, y[apart]))
    return Network(share, middle, scale, *weights, float(best))


def held_out(doc_id) -> F.Column:
    """The rows whose labels aren't learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def examples(documents: DataFrame, labels: DataFrame, vectors: np.ndarray, label: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Pooled vectors and labels of at most SAMPLE labelled documents that aren't held out."""
    marks = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg(label).alias("mark"))
    marks = marks.where(F.col("mark").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = documents.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("doc_id", "text", (F.col("mark") >= 0.5).cast("int").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, owner in _texts(batches):
            x = pooled(words, owner, batch.num_rows, vectors)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, batch.column("y")], names=["doc_id", "x", "y"])

    made = rows.mapInArrow(run, "doc_id long, x array<double>, y int")
    # one example per labelled id, whatever copies of the row there are
    kept = made.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("e")).orderBy(F.xxhash64("doc_id"), "doc_id").select("e.x", "e.y").toArrow()
    if not kept.num_rows:
        return np.zeros((0, 2 * SIZE + 2)), np.zeros(0)
    return np.array(kept["x"].to_pylist()), kept["y"].to_numpy().astype(float)


def trained(documents: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, Network]:
    """Word vectors of all texts, and the network."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vectors = word_vectors(*context_vectors(documents))
    return vectors, fit(*examples(documents, labels.select(F.col("doc_id").cast("long").alias("doc_id"), label), vectors, label))


def scored(documents: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, owner in _texts(batches):
            scores = network.scores(pooled(words, owner, batch.num_rows, vectors))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    made = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
