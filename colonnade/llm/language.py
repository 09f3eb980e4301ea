"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs.  A three-letter gram is the product of its letters' vectors, the
first two permuted (rotated by two and by one place), so order counts.  A text is the sum of its grams'
vectors, a language the sum over its texts, and a text belongs to the language of the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.llm.arrays import joined, slices, text_bytes
from colonnade.llm.characters import END, folded_texts
from colonnade.llm.tables import filled, table

DIMENSIONS = 1024
SEED = 5
#: More languages than this are a mistake in the column, not languages.
LANGUAGES = 1000
UNKNOWN = "und"
#: Sums of one language that are added up in a task of their own before the last sum.
SPREAD = 32

_letters: dict[tuple[int, int], np.ndarray] = {}


def letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    """The random signs of code points."""
    out = np.empty((len(points), dimensions), np.int8)
    for i, p in enumerate(points.tolist()):
        key = (p, dimensions)
        if key not in _letters:
            if len(_letters) > 20_000:
                _letters.clear()
            _letters[key] = np.random.default_rng((SEED, p)).choice(np.array([-1, 1], np.int8), dimensions)
        out[i] = _letters[key]
    return out


def gram_counts(data: np.ndarray, at: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: the distinct grams as rows of three code points, then text, gram and count of all that occur."""
    buffer, start = joined(data, at, first, last, fill=END)
    points, _, begin, _ = folded_texts(buffer, start, letters_only=True)
    letters, symbol = np.unique(points, return_inverse=True)
    n = max(0, len(points) - 2)
    size = len(letters)
    whole = (points[:n] != END) & (points[1 : n + 1] != END) & (points[2 : n + 2] != END)
    place = np.flatnonzero(whole)
    code = (symbol[place].astype(np.int64) * size + symbol[place + 1]) * size + symbol[place + 2]
    kinds, gram = np.unique(code, return_inverse=True)
    text = np.searchsorted(begin, place, side="right") - 1
    pair, count = np.unique(text * max(1, len(kinds)) + gram, return_counts=True)
    grams = np.stack([letters[kinds // size // size], letters[kinds // size % size], letters[kinds % size]], axis=1)
    return grams, pair // max(1, len(kinds)), pair % max(1, len(kinds)), count


def gram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """The bound vectors of grams."""
    letters, which = np.unique(grams, return_inverse=True)
    which = which.reshape(grams.shape)
    plain = letter_vectors(letters, dimensions)
    once, twice = np.roll(plain, 1, axis=1), np.roll(plain, 2, axis=1)
    return twice[which[:, 0]] * once[which[:, 1]] * plain[which[:, 2]]


def _lettered(data: np.ndarray, at: np.ndarray, first: int, last: int) -> np.ndarray:
    """Which texts have a letter."""
    buffer, start = joined(data, at, first, last, fill=END)
    points, _, begin, _ = folded_texts(buffer, start, letters_only=True)
    return np.add.reduceat(((points != END) & (points != 32)).astype(np.int64), begin[:-1]) > 0


#: Grams whose vectors are in memory at a time, and texts multiplied with them.
_GRAMS, _TEXTS = 2048, 512
#: Bytes of text whose grams are counted at a time.
_SLICE = 1 << 19


def _bundled(rows: np.ndarray, columns: np.ndarray, counts: np.ndarray, n: int, grams: np.ndarray, dimensions: int) -> np.ndarray:
    """Sums of gram vectors: row ``rows[i]`` gets ``counts[i]`` times the vector of ``columns[i]``."""
    out = np.zeros((n, dimensions), np.float32)
    order = np.argsort(columns, kind="stable")
    rows, columns, counts = rows[order], columns[order], counts[order]
    for low in range(0, len(grams), _GRAMS):
        a, b = np.searchsorted(columns, (low, low + _GRAMS))
        vectors = gram_vectors(grams[low : low + _GRAMS], dimensions).astype(np.float32)
        for base in range(0, n, _TEXTS):
            own = a + np.flatnonzero((rows[a:b] >= base) & (rows[a:b] < base + _TEXTS))
            dense = np.zeros((min(_TEXTS, n - base), len(vectors)), np.float32)
            dense[rows[own] - base, columns[own] - low] = counts[own]
            out[base : base + _TEXTS] += dense @ vectors
    return out


def _learned(dimensions: int):
    """Sums of gram vectors by language, one row a language and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            data, at = text_bytes(batch.column("_text"))
            names, lang = np.unique(np.array(batch.column("_lang").to_pylist(), object), return_inverse=True)
            for first, last in slices(at, _SLICE):
                grams, text, gram, count = gram_counts(data, at, first, last)
                own = lang[first:last][text]
                pair, inverse = np.unique(own * max(1, len(grams)) + gram, return_inverse=True)
                sums = np.bincount(inverse, count, minlength=len(pair))
                vectors = _bundled(pair // max(1, len(grams)), pair % max(1, len(grams)), sums, len(names), grams, dimensions)
                for name, vector in zip(names, vectors, strict=True):
                    if vector.any():
                        total[name] = total.get(name, 0) + vector.astype(np.float64)
        if total:
            yield pa.RecordBatch.from_pydict({"_lang": pa.array(list(total), pa.string()), "vector": pa.array(list(total.values()), pa.list_(pa.float64()))})

    return run


def _added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = sum(np.array(v, np.float64) for b in batches for v in b.column("vector").to_pylist())
    yield pa.RecordBatch.from_pydict({"_lang": pa.array([key[0].as_py()], pa.string()), "vector": pa.array([total], pa.list_(pa.float64()))})


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The unit vector of every language of labelled documents.

    Tasks send one vector a language, whatever their rows, and those are added up in two steps.  Only
    ``LANGUAGES`` vectors may reach the driver; more are an error.
    """
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("_lang"), filled(text).alias("_text"))
    schema = "_lang string, vector array<double>"
    sums = rows.mapInArrow(_learned(dimensions), schema).withColumn("_spread", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))

    sums = sums.groupBy("_lang", "_spread").applyInArrow(_added, schema).groupBy("_lang").applyInArrow(_added, schema)
    found = sums.limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"More than {LANGUAGES} languages")
    vectors = {r["_lang"]: np.array(r["vector"]) for r in found}
    return {k: v / np.linalg.norm(v) for k, v in sorted(vectors.items()) if v.any()}


def identified(docs: DataFrame, known: dict[str, np.ndarray], text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """Every row of ``docs`` with lang_pred and score, the cosine with the best profile or 0 if that is negative.

    A null text, a text without a letter, and every text if no language is known are ``und`` with score 0.
    Texts of one or two letters have no gram: they get the first language, with score 0.
    """
    names = list(known)
    matrix = np.array([known[k] for k in names], np.float32).reshape(len(names), dimensions)
    shared = docs.sparkSession.sparkContext.broadcast((names, matrix))  # at most LANGUAGES vectors
    taken = {c.lower() for c in docs.columns}
    body = next(c for c in ("_text" + "_" * k for k in range(len(taken) + 1)) if c not in taken)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        for batch in batches:
            data, at = text_bytes(batch.column(body))
            rest = batch.select([c for c in batch.schema.names if c != body])
            for first, last in slices(at, _SLICE):
                n = last - first
                pred, score = np.full(n, UNKNOWN, object), np.zeros(n)
                if names:
                    grams, row, gram, count = gram_counts(data, at, first, last)
                    bundle = _bundled(row, gram, count, n, grams, dimensions)
                    cosine = bundle @ matrix.T / np.maximum(np.linalg.norm(bundle, axis=1, keepdims=True), 1e-9)
                    best = np.argmax(cosine, axis=1)
                    lettered = _lettered(data, at, first, last)
                    pred[lettered] = np.array(names, object)[best[lettered]]
                    score[lettered] = np.clip(cosine[np.arange(n), best], 0, 1)[lettered]
                part = rest.slice(first, n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score)], [*part.schema.names, "lang_pred", "score"])

    fields = [f for f in docs.schema.fields if f.name.lower() not in ("lang_pred", "score")]  # replaced
    kept = docs.select(*[F.col(f"`{f.name}`") for f in fields], filled(text).alias(body))
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(run, schema)


def held_out_ids(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang and held_out: the checksum of the doc_id as text leaves 2 when divided by 4; a null id is an empty text."""
    checksum = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select("doc_id", "text", "lang", (checksum % 4 == 2).alias("held_out"))


def language_of(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from the documents that are not held out."""
    rows = held_out_ids(docs)
    known = profiles(rows.where(~F.col("held_out")))
    return identified(rows.select("doc_id", "held_out", "text"), known).select("doc_id", "held_out", "lang_pred", "score")


def op5_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of(table(spark, sf_dir, "documents"))
