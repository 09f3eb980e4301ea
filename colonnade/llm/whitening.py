"""Whitening of embeddings: blockwise QR, and a bidiagonal qd solver for what is left of it.

1. Entries become whole numbers, floor(256 c); every distinct vector counts once, packed in as few bytes as
   its largest entry needs.
2. Counts and sums of the distinct vectors are exact.  Centred rows are reduced block by block by QR to one
   triangular factor a task, and factors by QR again, a few at a time.
3. The last factor, as wide and high as vectors are long, is bidiagonalised; dqds and twisted factorisations
   give variances and directions (``bidiagonal.py``).
4. Another pass over the distinct vectors checks the covariance of what whitening makes of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.bidiagonal import leading_directions
from colonnade.llm.tables import cut, table

COMPONENTS = 4
SCALE = 256
#: Entries that a task works on at a time, rows of a QR block for each dimension, and partial results that are merged at a time.
ENTRIES = 1 << 20
TALL = 32
FAN = 16
#: A component whose standard deviation is below this share of the first one's has no variance.
LEAST_SPREAD = 1e-12

_PARTIAL = "part long, state binary"


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is there and has neither null nor non-finite entries."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return rows.where(F.col(vector).isNotNull() & F.forall(vector, finite))


def _whole(values: np.ndarray, lengths: np.ndarray, dims: int) -> np.ndarray:
    """Whole entries of vectors, one a row; shorter vectors end with zeros.  Beyond 63 bits the nearest long stands."""
    x = np.floor(SCALE * values) + 0.0
    big = np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    big[x >= 2.0**63] = np.iinfo(np.int64).max
    if (lengths == dims).all():
        return big.reshape(-1, dims)
    out = np.zeros((len(lengths), dims), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = big
    return out


def _matrices(column: pa.Array, dims: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Rows [first, last) of a column of vectors as whole numbers, a bounded number at a time."""
    step = max(1, ENTRIES // max(1, dims))
    for first in range(0, len(column), step):
        part = column.slice(first, step)
        values = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        lengths = np.diff(part.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
        yield first, first + len(part), _whole(values, lengths, dims)


def _packed(dims: int):
    """Every vector as bytes: entries of 1, 2, 4 or 8 bytes, whichever is the least that holds them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, x in _matrices(batch.column(0), dims):
                high = np.maximum(x.max(axis=1, initial=0), -(x.min(axis=1, initial=0) + 1))
                width = np.select([high < 1 << 7, high < 1 << 15, high < 1 << 31], [1, 2, 4], 8)
                for w in np.unique(width).tolist():
                    rows = np.ascontiguousarray(x[width == w].astype(f"<i{w}"))
                    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(w * dims), len(rows), [None, pa.py_buffer(rows)])
                    yield pa.RecordBatch.from_pydict({"x": fixed.cast(pa.binary())})

    return run


def _unpacked(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    """The vectors of a task again as whole numbers, a bounded number at a time."""
    step = max(1, ENTRIES // max(1, dims))
    for batch in batches:
        column = batch.column("x")
        for first in range(0, len(column), step):
            part = column.slice(first, step)
            size = np.diff(np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1])
            for w in np.unique(size // dims).tolist():
                own = b"".join(part.filter(pa.array(size == w * dims)).to_pylist())
                yield np.frombuffer(own, f"<i{w}").reshape(-1, dims).astype(np.int64)


def _summed(dims: int):
    """Count and exact sums of the vectors of a task, entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for x in _unpacked(batches, dims):
            n += len(x)
            safe = max(abs(int(x.max())), abs(int(x.min()))) * len(x) < 1 << 62
            total = [t + int(s) for t, s in zip(total, (x if safe else x.astype(object)).sum(axis=0).tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict(
            {"at": pa.array(range(dims), pa.int32()), "n": pa.array([n] * dims, pa.int64()), "total": pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))}
        )

    return run


def _partials(first: Callable[[Iterator[np.ndarray]], bytes], dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = first(_unpacked(batches, dims))
        if state:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "state": pa.array([state], pa.binary())})

    return run


def _merged(distinct: DataFrame, dims: int, first: Callable[[Iterator[np.ndarray]], bytes], both: Callable[[list[bytes]], bytes]) -> bytes:
    """One state of all vectors: one a task, then one of every ``FAN`` until one is left."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        yield pa.RecordBatch.from_pydict({"part": pa.array([rows[0]["part"] // FAN], pa.int64()), "state": pa.array([both([r["state"] for r in rows])], pa.binary())})

    states = cut(distinct.mapInArrow(_partials(first, dims), _PARTIAL))
    while states.count() > 1:
        states = cut(states.groupBy(F.expr(f"part div {FAN}")).applyInArrow(merge, _PARTIAL))
    return states.first()["state"]


def _triangle(rows: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(rows), mode="r")


def _factor(mean: np.ndarray):
    """The triangular factor of the centred vectors of a task."""
    dims = len(mean)

    def run(blocks: Iterator[np.ndarray]) -> bytes:
        factor, held = np.zeros((0, dims)), []
        for x in blocks:
            for k in range(0, len(x), TALL * dims):
                held.append(x[k : k + TALL * dims] - mean)
                if sum(map(len, held)) >= TALL * dims:
                    factor, held = _triangle([factor, *held]), []
        return (_triangle([factor, *held]) if held else factor).tobytes()

    return run


def _factors(dims: int):
    def run(states: list[bytes]) -> bytes:
        return _triangle([np.frombuffer(s).reshape(-1, dims) for s in states]).tobytes()

    return run


def _moments(mean: np.ndarray, directions: np.ndarray):
    """Count, mean and centred products of the whitened vectors of a task."""

    def run(blocks: Iterator[np.ndarray]) -> bytes:
        state = b""
        for x in blocks:
            w = (x - mean) @ directions
            own = w.mean(axis=0)
            w = w - own
            state = _pooled([s for s in (state, np.concatenate(([len(w)], own, (w.T @ w).ravel())).tobytes()) if s])
        return state

    return run


def _pooled(states: list[bytes]) -> bytes:
    """The moments of several sets of vectors together; means are moved before products are added."""
    n, mean, products = 0.0, 0.0, 0.0
    for s in states:
        s = np.frombuffer(s)
        k = int(np.sqrt(len(s)))  # 1 + k + k*k numbers
        m, own, apart = s[0], s[1 : k + 1], s[1 : k + 1] - mean
        products = products + s[k + 1 :].reshape(k, k) + np.outer(apart, apart) * (n * m / (n + m))
        mean = mean + apart * (m / (n + m))
        n += m
    return np.concatenate(([n], mean, products.ravel())).tobytes()


def _squares(y: np.ndarray) -> pa.Array:
    """The exact sum of squares of every row of whole numbers."""
    kind = pa.decimal128(38, 0)
    high = int(np.abs(y).max(initial=0))
    if high * high * y.shape[1] < 1 << 63:
        return pa.array((y * y).sum(axis=1), pa.int64()).cast(kind)
    low, up = y & ((1 << 28) - 1), y >> 28  # below 2^28, and below 2^34 in size
    total = [0] * len(y)
    for a, b, shift in ((low, low, 0), (low, up, 29), (up, up, 56)):
        for part, more in ((lambda p: p & ((1 << 31) - 1), 0), (lambda p: p >> 31, 31)):
            if shift < 56:
                sums = part(a * b).sum(axis=1).tolist()
            else:  # 68 bits: by halves of one factor
                sums = [u + (v << 17) for u, v in zip(part(a * (b & 0x1FFFF)).sum(axis=1).tolist(), part(a * (b >> 17)).sum(axis=1).tolist(), strict=True)]
            total = [t + (s << shift + more) for t, s in zip(total, sums, strict=True)]
    return pa.array([Decimal(t) if t < 10**38 else None for t in total], kind)


def _whitened(dims: int, n: int, sums: list[int], directions: np.ndarray, flat: np.ndarray):
    mean = np.array([s / n for s in sums])
    k = directions.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, x in _matrices(batch.column("_vector"), dims):
                if n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, sums)) < 1 << 61:
                    deviation = _squares(n * x - np.array(sums, np.int64))
                else:
                    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
                    deviation = pa.array([Decimal(v) if v < 10**38 else None for v in exact.tolist()], pa.decimal128(38, 0))
                w = (x - mean) @ directions
                each = pa.array(np.repeat(np.arange(last - first), k))
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": batch.column("id").slice(first, last - first).take(each),
                        "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), last - first)),
                        "deviation": deviation.take(each),
                        "whitened": pa.array(w.ravel(), mask=np.tile(flat, last - first)),
                    }
                )

    return run


def whitened(rows: DataFrame, vector: str = "embedding", identity: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Every usable row in the leading whitening directions of all distinct vectors, one row a component.

    Returns ``identity``, component (from 1, by falling variance), n (distinct vectors), deviation (sum over
    dimensions of (n x - sum)^2, exact, decimal; null from 10^38 on), whitened, explained (the component's
    share of the variance) and identity_error (the largest entry of whitened's covariance over the distinct
    vectors, less the identity; the same on all rows).

    Rows whose vector is null or holds a null or non-finite entry give no rows; repeated rows give theirs each
    time and count once in the fit; a null id stays null.  A vector shorter than the longest counts as
    followed by zeros, and components are at most as many as its entries.  Where a component has no variance
    (fewer distinct vectors than components, constant entries) whitened is null and identity_error leaves it
    out; without any variance explained and identity_error are null.  Without usable rows there are none.
    Other columns of ``rows`` are not looked at.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[identity]
    chosen = usable(rows.select(F.col(identity).alias("id"), F.col(vector).alias("_vector")), "_vector").withColumn("_vector", F.col("_vector").cast("array<double>"))
    dims = chosen.agg(F.max(F.size("_vector"))).first()[0] or 0
    if not dims:
        return spark.createDataFrame([], f"`{identity}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    distinct = cut(chosen.select("_vector").mapInArrow(_packed(dims), "x binary").distinct())
    added = distinct.mapInArrow(_summed(dims), "at int, n long, total decimal(38,0)").groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("at").collect()
    n, sums = added[0]["n"], [int(r["total"]) for r in added]
    mean = np.array([s / n for s in sums])

    factor = np.frombuffer(_merged(distinct, dims, _factor(mean), _factors(dims))).reshape(-1, dims)
    square = np.zeros((dims, dims))
    square[: len(factor)] = factor
    values, directions = leading_directions(square, components)
    k = directions.shape[1]
    flat = np.sqrt(values[:k]) <= LEAST_SPREAD * np.sqrt(values[0])
    variance, trace = values[:k] / n, float(np.sum(factor * factor)) / n
    directions = np.where(flat, 0.0, directions / np.sqrt(np.where(flat, 1.0, variance)))
    error = None
    if not flat.all():
        moments = np.frombuffer(_merged(distinct, dims, _moments(mean, directions), _pooled))
        off = moments[k + 1 :].reshape(k, k) / n - np.eye(k)
        error = float(np.abs(off[np.ix_(~flat, ~flat)]).max())
    share = F.array(*(F.lit(float(v) / trace if trace else None).cast("double") for v in variance))
    found = chosen.mapInArrow(_whitened(dims, n, sums, directions, flat), f"id {kind}, component int, deviation decimal(38,0), whitened double")
    return found.select(
        F.col("id").alias(identity),
        "component",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(share, F.col("component")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitened(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))
