"""Quality rules: counts of each text, and lines that many documents of a host share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.arrays import joined, mixed, range_hashes, slices, text_bytes, word_ranges
from colonnade.llm.tables import filled, table

#: A line in more distinct documents of one host than this is boilerplate there.
LINE_LIMIT = 100
#: A document is depleted if less than this share of its words remains without boilerplate lines.
LEAST_LEFT = 0.25
WINDOW = 5
#: Bytes of text counted at a time: the arrays take some fifty bytes for each.
COUNTED = 1 << 18

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of a value per byte, text by text."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[begin[1:]] - total[begin[:-1]]


def _repeats(keys: np.ndarray) -> np.ndarray:
    """How often each key occurs, at every place."""
    if not len(keys):
        return np.zeros(0, np.int64)
    order = np.argsort(keys)
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    size = np.diff(np.append(first, len(keys)))
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(size, size)
    return out


def counts_of(data: np.ndarray, at: np.ndarray, first: int, last: int) -> dict[str, np.ndarray]:
    """The five counts of the texts in rows [first, last)."""
    n = last - first
    buffer, begin = joined(data, at, first, last)
    starts, ends, inside = word_ranges(buffer)
    of = np.searchsorted(begin, starts, side="right") - 1  # the text of each word
    n_words = np.bincount(of, minlength=n)

    breaks = np.flatnonzero(buffer == 10)
    line_starts = np.concatenate(([0], breaks[:-1] + 1))
    worded = np.searchsorted(starts, breaks) > np.searchsorted(starts, line_starts)
    line_of = np.searchsorted(begin, line_starts[worded], side="right") - 1
    lines = range_hashes(buffer, line_starts[worded], breaks[worded])
    distinct = np.unique(mixed(lines + line_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if len(lines) else lines, return_index=True)[1]
    duplicates = np.bincount(line_of, minlength=n) - np.bincount(line_of[distinct], minlength=n)

    repeated = np.zeros(n, np.int64)
    if len(starts) >= WINDOW:
        words = range_hashes(buffer, starts, ends)
        window = np.zeros(len(words) - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            window = window * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(window)]
        window = mixed(window + of[: len(window)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        whole = np.flatnonzero(of[: len(window)] == of[WINDOW - 1 :])
        twice = whole[_repeats(window[whole]) > 1]
        edge = np.bincount(twice, minlength=len(words) + 1) - np.bincount(twice + WINDOW, minlength=len(words) + 1)[: len(words) + 1]
        repeated = np.bincount(of[np.cumsum(edge[: len(words)]) > 0], minlength=n)
    return {
        "n_words": n_words,
        "word_chars": _per_text(inside & ((buffer & 0xC0) != 0x80), begin),
        "n_symbols": _per_text(_SYMBOL[buffer], begin),
        "n_dup_lines": duplicates,
        "n_repeat_words": repeated,
    }


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = text_bytes(batch.column("_text"))
        for first, last in slices(at, COUNTED):
            found = counts_of(data, at, first, last)
            own = batch.slice(first, last - first)
            yield pa.RecordBatch.from_pydict(
                {c: own.column(c) for c in ("doc_id", "_host", "_copy")} | {c: pa.array(v, pa.int64()) for c, v in found.items()}
            )


def line_frequency_rules(
    docs: DataFrame, host: str = "source", text: str = "text", limit: int = LINE_LIMIT, least_left: float = LEAST_LEFT
) -> DataFrame:
    """Counts, the base rules, and the verdict on every document.

    Lines are normalised (one space between words, none around, lower case) and hashed.  A line is
    boilerplate on a host if more than ``limit`` distinct documents of the host hold it, whether or not they
    are copies of each other.  Boilerplate lines are removed, and a document that keeps less than
    ``least_left`` of its words is rejected, as is one that fails the base rules (under 10 words, or over a
    fifth of its words in repeated five-word windows).

    A document is a doc_id with a text: repeated rows are one document, and rows with a null doc_id one for
    each text.  A null text is an empty one and fails the base rules.  Rows with a null host form a host.
    Repeated rows get equal answers.  Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_line_words_removed, kept.
    """
    rows = docs.select(F.col("doc_id"), F.col(host).cast("string").alias("_host"), filled(text).alias("_text"))
    rows = rows.withColumn("_copy", F.xxhash64("_text"))
    base = rows.mapInArrow(
        _counted,
        "doc_id {}, _host string, _copy long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long".format(
            dict(docs.dtypes)["doc_id"]
        ),
    )
    line = F.lower(F.trim(F.regexp_replace("_line", r"[\x20\x09-\x0D]+", " ")))
    lines = (
        rows.select("_host", "_copy", F.explode(F.split("_text", "\n")).alias("_line"))
        .select("_host", "_copy", line.alias("_line"))
        .where(F.col("_line") != "")
        .select("_host", "_copy", F.xxhash64("_line").alias("_hash"), F.size(F.split("_line", " ")).cast("long").alias("_words"))
        .groupBy("_host", "_hash", "_words", "_copy")  # hash and number of words stand for a line; all uses below read this one shuffle
        .agg(F.count(F.lit(1)).alias("_lines"))
    )
    copies = rows.groupBy("_host", "_copy", "doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    copies = copies.groupBy("_host", "_copy").agg(F.sum("_rows").alias("_rows"), F.count(F.lit(1)).alias("_docs"))

    def on(a: str, b: str, *keys: str) -> Column:
        same = F.col(f"{a}._host").eqNullSafe(F.col(f"{b}._host"))
        for k in keys:
            same = same & (F.col(f"{a}.{k}") == F.col(f"{b}.{k}"))
        return same

    # no line is in more documents than it has occurrences: only those with enough are looked at again
    often = lines.groupBy("_host", "_hash", "_words").agg(F.sum("_lines").alias("_lines")).where(F.col("_lines") > limit)
    held = lines.alias("a").join(often.alias("b"), on("a", "b", "_hash", "_words"), "left_semi").alias("h").join(copies.alias("c"), on("h", "c", "_copy"))
    of_one = (F.col("h._words") * F.col("h._lines") / F.col("c._rows")).cast("long").alias("_gone")  # words of the line in one copy
    held = held.select("h._host", "h._hash", "h._words", "h._copy", "c._docs", of_one)
    frequent = held.groupBy("_host", "_hash", "_words").agg(F.sum("_docs").alias("_docs")).where(F.col("_docs") > limit)
    removed = held.alias("a").join(frequent.alias("b"), on("a", "b", "_hash", "_words"), "left_semi")
    per_text = removed.groupBy("_host", "_copy").agg(F.sum("_gone").alias("_gone"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    gone = F.coalesce(F.col("_gone"), F.lit(0))
    return (
        base.alias("d")
        .join(per_text.alias("p"), on("d", "p", "_copy"), "left")
        .select(
            *(f"d.{c}" for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
            failed.alias("base_failed"),
            gone.alias("n_line_words_removed"),
            (~failed & ((F.col("n_words") - gone) >= least_left * F.col("n_words"))).alias("kept"),
        )
    )


def op9_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency_rules(table(spark, sf_dir, "documents"))
