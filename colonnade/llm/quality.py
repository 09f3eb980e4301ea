"""Quality scores: random-indexing word vectors pooled per document, and a small calibrated network.

Random indexing gives every word bucket a fixed sparse vector of signs; the vector of a word is the sum of
the fixed vectors of the words around it, over the whole corpus, in one pass and in space that does not grow
with the vocabulary.  Words are runs of letters, digits or other signs in lower case; how a run is written
(capitals, a repetition of the word before) is a word of its own next to it.  A document is the mean of its
words' vectors.  A network of two layers scores it, and a temperature fitted on rows that it did not learn
from turns the scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.arrays import joined, range_hashes, slices, text_bytes
from colonnade.llm.tables import filled, table

BUCKETS = 1 << 14
DIMENSIONS = 64
#: Nonzero signs of a fixed vector.
SIGNS = 8
#: Labelled documents that the network is fitted on, at most: those with the least hash of their id.
SAMPLE = 20_000
HIDDEN = 32
THRESHOLD = 0.3
#: Buckets summed in one row.
_BLOCK = 512
#: Rows of four signs plus one, 8 at most, whose sums fit 16 bits.
_ROWS = 8000
#: Ids of the shapes: all capitals, first capital, repetition of the word before, long run of signs.
_SHAPES = 4

_KIND = np.full(256, 3, np.uint8)  # 0 blank, 1 letter, 2 digit, 3 sign
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1
_KIND[48:58] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True


def fixed_vectors() -> np.ndarray:
    """The index vectors of all buckets: ``SIGNS`` random signs each."""
    rng = np.random.default_rng(3)
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    place = np.argsort(rng.random((BUCKETS, DIMENSIONS)), axis=1)[:, :SIGNS]
    out[np.arange(BUCKETS)[:, None], place] = rng.choice(np.array([-1, 1], np.float32), (BUCKETS, SIGNS))
    return out


def tokens_of(data: np.ndarray, at: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of all words of some texts, in order; a shape stands right after its word."""
    buffer, begin = joined(data, at, first, last)
    kind = _KIND[buffer]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    bound = np.concatenate(([0], edge, [len(buffer)]))
    starts, ends = bound[:-1], bound[1:]
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    h = range_hashes(_LOWER[buffer], starts, ends)
    capitals = np.concatenate(([0], np.cumsum(_CAPITAL[buffer])))
    upper, letters = capitals[ends] - capitals[starts], kind[starts] == 1
    shape = np.full(len(starts), -1)
    shape[letters & (upper > 0)] = 1
    shape[letters & (upper == ends - starts) & (ends - starts > 1)] = 0
    shape[(kind[starts] == 3) & (ends - starts > 1)] = 3
    text = np.searchsorted(begin, starts, side="right") - 1
    spoken = np.flatnonzero(letters)
    again = spoken[1:][(h[spoken[1:]] == h[spoken[:-1]]) & (text[spoken[1:]] == text[spoken[:-1]])]
    shape[again] = 2
    bucket = _SHAPES + (h % np.uint64(BUCKETS - _SHAPES)).astype(np.int64)
    many = 1 + (shape >= 0)
    out = np.repeat(bucket, many)
    shaped = np.cumsum(many)[shape >= 0] - 1
    out[shaped] = shape[shape >= 0]
    return out, np.repeat(text, many)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a task: for every bucket, the fixed vectors of the two words on either side."""
    # signs and their sums are small whole numbers: four are added at a time, each plus one in 16 bits of its own; the last row stands for no word
    fixed = (np.concatenate((fixed_vectors(), np.zeros((1, DIMENSIONS)))) + 1).astype(np.uint16).view(np.uint64)
    total = np.zeros((BUCKETS, DIMENSIONS), np.float64)
    for batch in batches:
        data, at = text_bytes(batch.column("_text"))
        for first, last in slices(at, 1 << 18):
            bucket, text = tokens_of(data, at, first, last)
            if not len(bucket):
                continue
            # two places without a word around every text keep its neighbours out
            spot = 2 + np.arange(len(bucket)) + 2 * np.concatenate(([0], np.cumsum(text[1:] != text[:-1])))
            padded = np.full(spot[-1] + 3, BUCKETS)
            padded[spot] = bucket
            signs = fixed[padded]
            around = signs[:-4] + signs[1:-3]
            around += signs[3:-1]
            around += signs[4:]
            order = np.argsort(bucket.astype(np.uint16), kind="stable")
            ranked = bucket[order]
            first_of = np.concatenate(([True], ranked[1:] != ranked[:-1]))
            first_of[::_ROWS] = True
            start = np.flatnonzero(first_of)
            sums = np.add.reduceat(around[spot[order] - 2], start, axis=0).view(np.uint16).astype(np.int64)
            sums -= 4 * np.diff(np.append(start, len(order)))[:, None]
            place = ranked[start]
            own = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            total[place[own]] += np.add.reduceat(sums, own, axis=0)
    if total.any():
        rows = total.astype(np.float32).reshape(-1, _BLOCK * DIMENSIONS)
        yield pa.RecordBatch.from_pydict({"_block": pa.array(np.arange(len(rows))), "sums": pa.array([r.tobytes() for r in rows], pa.binary())})


def _summed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = sum(np.frombuffer(r, np.float32).astype(np.float64) for b in batches for r in b.column("sums").to_pylist())
    yield pa.RecordBatch.from_pydict({"_block": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The vectors of all buckets, from every document: ``BUCKETS`` x ``DIMENSIONS`` whatever the corpus."""
    schema = "_block long, sums binary"
    spread = docs.select(filled(text).alias("_text")).mapInArrow(_contexts, schema).withColumn("_spread", F.pmod(F.spark_partition_id(), F.lit(16)))
    once = spread.groupBy("_block", "_spread").applyInArrow(_summed, schema)
    rows = once.groupBy("_block").applyInArrow(_summed, schema).collect()  # BUCKETS / _BLOCK rows
    out = np.zeros((BUCKETS // _BLOCK, _BLOCK * DIMENSIONS), np.float32)
    for r in rows:
        out[r["_block"]] = np.frombuffer(r["sums"], np.float32)
    out = out.reshape(BUCKETS, DIMENSIONS)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return (out + fixed_vectors() / np.sqrt(SIGNS)).astype(np.float32)


def pooled(data: np.ndarray, at: np.ndarray, first: int, last: int, vectors: np.ndarray) -> np.ndarray:
    """The mean vector of every text; zero for a text without words."""
    bucket, text = tokens_of(data, at, first, last)
    out = np.zeros((last - first, DIMENSIONS), np.float32)
    if len(text):
        start = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        size = np.diff(np.append(start, len(text)))[:, None]
        out[text[start]] = np.add.reduceat(vectors[bucket], start, axis=0) / size
    return out


class Network:
    """Inputs to a hidden layer of tanh to one logit, divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 30, seed: int = 3):
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        calibrate, learn = order[: len(order) // 5], order[len(order) // 5 :]
        self.mean, self.scale = x[learn].mean(axis=0), x[learn].std(axis=0) + 1e-6
        width = x.shape[1]
        self.weights = [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        moment, square, step = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        z = self._scaled(x)
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(learn), max(1, len(learn) // 128)):
                inner = np.tanh(z[batch] @ self.weights[0] + self.weights[1])
                error = (1 / (1 + np.exp(-np.clip(inner @ self.weights[2] + self.weights[3], -30, 30))) - y[batch]) / len(batch)
                back = np.outer(error, self.weights[2]) * (1 - inner**2)
                slopes = [z[batch].T @ back + 1e-4 * self.weights[0], back.sum(axis=0), inner.T @ error, error.sum(keepdims=True)]
                step += 1
                for w, g, m, s in zip(self.weights, slopes, moment, square, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    w -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        self.temperature = self._calibrated(self._logit(x[calibrate]), y[calibrate]) if len(calibrate) else 1.0

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -10, 10)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._scaled(x) @ self.weights[0] + self.weights[1]) @ self.weights[2] + self.weights[3]

    @staticmethod
    def _calibrated(logit: np.ndarray, y: np.ndarray) -> float:
        """The temperature of the least log loss."""
        grid = np.exp(np.linspace(np.log(0.2), np.log(10), 80))
        loss = [np.mean(np.logaddexp(0, logit / t) - y * logit / t) for t in grid]
        return float(grid[int(np.argmin(loss))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -30, 30)))


def fitted(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Network | float:
    """The network fitted on a bounded sample of labelled documents; a constant if the labels hold one class or none."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col(label) > 0).cast("int").alias("_label"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(sample))  # at most ``sample`` rows
    rows = docs.select("doc_id", filled(text).alias("_text")).join(chosen, "doc_id").select("doc_id", "_label", "_text")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column("_text"))
            for first, last in slices(at, 1 << 18):
                x = pooled(data, at, first, last, shared.value)
                own = batch.slice(first, last - first)
                yield pa.RecordBatch.from_pydict({"doc_id": own.column("doc_id").cast(pa.int64()), "_label": own.column("_label"), "x": pa.array(list(x), pa.list_(pa.float32()))})

    found = rows.mapInArrow(run, "doc_id long, _label int, x array<float>").orderBy("doc_id", "_label").limit(2 * sample).collect()
    y = np.array([r["_label"] for r in found], float)
    if len(set(y)) < 2:
        return float(y[0]) if len(y) else 0.5
    return Network(np.array([r["x"] for r in found], float), y)


def scored(docs: DataFrame, network: Network | float, vectors: np.ndarray, text: str = "text") -> DataFrame:
    """doc_id and score, the probability of label 1, of every row.  Null and empty texts are scored as texts without words."""
    shared = docs.sparkSession.sparkContext.broadcast((network, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, vectors = shared.value
        for batch in batches:
            data, at = text_bytes(batch.column("_text"))
            for first, last in slices(at, 1 << 18):
                x = pooled(data, at, first, last, vectors)
                score = np.full(len(x), network) if isinstance(network, float) else network.score(x)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(first, last - first), "score": pa.array(score.astype(float))})

    return docs.select("doc_id", filled(text).alias("_text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def _held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def quality_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels of held-out documents are not looked at."""
    vectors = word_vectors(docs)
    network = fitted(docs, labels.where(~_held_out()), vectors)
    return scored(docs, network, vectors).select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
