"""Best stored match per query vector by cosine, within the same dataset."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.plans import angles
from colonnade.plans.scale import materialize

HIT_THRESHOLD = 0.88
#: Vectors of one dataset are cut into blocks of about this many.
BLOCK = 2048
#: Rows of a block that are multiplied at a time, and by how much cosines differ through rounding.
_ROWS = 512
_TIE = 1e-12


def exact_text_matches(queries: DataFrame, stored: DataFrame, dataset: str = "dataset_id", text: str = "question", stored_id: str = "stored_id") -> DataFrame:
    """Left join each query to the lowest-numbered stored entry with the same dataset and text.

    Texts are compared, grouped and shuffled as SHA-256 digests.
    """
    digest = F.unhex(F.sha2(F.encode(F.col(text), "utf-8"), 256)).alias("__digest")
    first = stored.select(F.col(dataset), digest, F.col(stored_id)).groupBy(dataset, "__digest").agg(F.min(stored_id).alias("match_id"))
    return queries.withColumn("__digest", digest).join(first, [dataset, "__digest"], "left").drop("__digest").withColumn("hit", F.col("match_id").isNotNull())


def matches_with_fallback(
    queries: DataFrame,
    stored: DataFrame,
    dataset: str,
    query_id: str,
    stored_id: str,
    vector: str,
    text: str,
    threshold: float = HIT_THRESHOLD,
    skip_same_id: bool = False,
) -> DataFrame:
    """The nearest stored vector of queries that have a vector, the same text for those that have none.

    Returns query_id, dataset, match_id, similarity (null for a match by text) and hit.
    """
    near = best_matches(queries.where(F.col(vector).isNotNull()), stored, dataset, query_id, stored_id, vector, threshold, skip_same_id)
    plain = queries.where(F.col(vector).isNull()).select(query_id, dataset, text)
    entries = stored.select(F.col(dataset), F.col(text), F.col(stored_id).alias("__stored"))
    same = exact_text_matches(plain, entries, dataset, text, "__stored")
    return near.unionByName(same.select(query_id, dataset, "match_id", F.lit(None).cast("double").alias("similarity"), "hit"))


def best_matches(
    queries: DataFrame,
    stored: DataFrame,
    dataset: str,
    query_id: str,
    stored_id: str,
    vector: str,
    threshold: float = HIT_THRESHOLD,
    skip_same_id: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """For every query the stored vector with the highest cosine and whether it reaches the threshold.

    Vectors of unequal lengths, and those of zeros or with a null or non-finite entry, have cosine 0; the
    lowest id wins a tie; a query whose dataset has no other vector gets no match, nor does one without an
    id, a dataset or a vector.  Of queries with one id in a dataset the best match counts for all.

    Both sides are cut into cells around pivots and blocks of about ``block`` vectors (``plans.angles``).  The
    queries of a cell are first compared with the block most likely to be near; then only with cells whose
    members can be as near as what they have found.  A task compares what is left of two blocks by matrix
    product and hands on one row a query.  Where vectors lie in clusters most pairs are never compared; where
    they lie in all directions alike no bound helps, and all pairs are.
    """
    asked, kept = angles.vectors(queries, dataset, query_id, vector), angles.vectors(stored, dataset, stored_id, vector)
    around = materialize(angles.pivots(kept, block))
    left = angles.placed(asked, around, block)
    right = left if (queries, query_id) == (stored, stored_id) else angles.placed(kept, around, block)
    stored_cells = angles.cells(right)

    first = angles.near_cells(angles.cells(left), stored_cells, around, True)
    seeded = materialize(_compared(left, right, first, skip_same_id))
    own = F.coalesce(F.acos(F.least(F.greatest("similarity", F.lit(-1.0)), F.lit(1.0))), F.lit(4.0))  # none found: above all angles
    seeded = seeded.withColumn("own", own)
    asking = angles.cells(seeded, F.max("own").alias("reach"), F.first("other_block").alias("first_block"))
    rest = angles.near_cells(asking, stored_cells, around, False)
    more = _compared(seeded.select(*_PLACED, "own"), right, rest, skip_same_id)

    found = seeded.select(*_FOUND).unionByName(more.select(*_FOUND)).where(F.col("similarity").isNotNull())
    found = found.unionByName(_without_angle(asked, kept, skip_same_id))
    best = found.groupBy(F.col("dataset").alias("__dataset"), F.col("id").alias("__id")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "match_id")).alias("best"))
    best = best.select("__dataset", "__id", F.col("best")["match_id"].alias("match_id"), (0.0 - F.col("best")["s"]).alias("similarity"))
    return (
        queries.select(query_id, dataset)
        .join(best, (F.col(query_id) == F.col("__id")) & (F.col(dataset) == F.col("__dataset")), "left")
        .select(query_id, dataset, "match_id", "similarity", F.coalesce(F.col("similarity") >= threshold, F.lit(False)).alias("hit"))
    )


_PLACED = ["dataset", "kind", "block", "cell", "angle", "id", "vec"]
_FOUND = ["dataset", "id", "match_id", "similarity"]
_KEYS = ["dataset", "kind", "block", "other_block"]


def _sides(left: DataFrame, right: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What two blocks have to compare: queries, and stored vectors.

    Where ``pairs`` lists cells, only those vectors of the stored block, and only queries that one of the cells
    may be nearer to than ``own``, the angle they have found.
    """
    rows = left.join(pairs, ["dataset", "kind", "block", "cell"])
    if "near" not in pairs.columns:
        wanted, place = pairs.select(*_KEYS).distinct(), ["dataset", "kind", "other_block"]
    else:
        angle, bar = F.col("angle"), F.col("own") + angles.SLACK
        fits = lambda c: F.greatest(c["theta"] - angle - c["high"], c["low"] - c["theta"] - angle, angle - c["theta"] - c["high"]) <= bar
        rows = rows.where(F.exists("near", fits))
        wanted = pairs.select(*_KEYS, F.explode("near.other_cell").alias("other_cell")).distinct()
        place = ["dataset", "kind", "other_block", "other_cell"]
    others = right.withColumnsRenamed({"block": "other_block", "cell": "other_cell", "id": "match_id", "vec": "other"}).join(wanted, place)
    # columns of their own: both sides may come from one table
    return rows.select(*_KEYS, "cell", "angle", "id", "vec"), others.select(*(F.col(c).alias(c) for c in (*_KEYS, "match_id", "other")))


def _compared(left: DataFrame, right: DataFrame, pairs: DataFrame, skip_same_id: bool) -> DataFrame:
    """The rows of ``left`` with their best match in each block that ``pairs`` names; null if a block has none but the query."""
    rows, other = _sides(left, right, pairs)

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        match, value = _best_in_block(a, b, skip_same_id)
        return a.assign(match_id=match, similarity=value)

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in rows.columns), f"match_id {dict(other.dtypes)['match_id']}", "similarity double"])
    return rows.groupBy(*_KEYS).cogroup(other.groupBy(*_KEYS)).applyInPandas(compare, schema)


def _best_in_block(a: pd.DataFrame, b: pd.DataFrame, skip_same_id: bool) -> tuple[pd.Series, np.ndarray]:
    """Of every vector in ``a`` the best in ``b`` and their cosine.  Cosines that differ by rounding only are a tie."""
    if a.empty or b.empty:
        return pd.Series([None] * len(a), dtype=object), np.full(len(a), np.nan)
    b = b.sort_values("match_id", kind="stable")
    x, y = angles.unit(a["vec"]), angles.unit(b["other"])
    ids, others = a["id"].to_numpy(), b["match_id"].to_numpy()
    pick, some = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
    for k in range(0, len(a), _ROWS):
        part = slice(k, k + _ROWS)
        scores = x[part] @ y.T
        if skip_same_id:
            scores[ids[part][:, None] == others[None, :]] = -np.inf
        top = scores.max(axis=1)
        some[part] = np.isfinite(top)
        pick[part] = (scores >= top[:, None] - _TIE).argmax(axis=1)  # the first is the lowest id
    # one order of addition, so that equal vectors have one cosine in whatever block they are
    value = np.clip(np.einsum("ij,ij->i", x, y[pick]), -1.0, 1.0)
    return pd.Series(np.where(some, others[pick], None), dtype=object, index=a.index), np.where(some, value, np.nan)


def _without_angle(asked: DataFrame, kept: DataFrame, skip_same_id: bool) -> DataFrame:
    """For every query the lowest stored id of cosine 0: another length on one side, or no direction on either.

    A dataset's two lowest ids of each length are enough, the second in case the first is the query's own.
    """
    kinds = ["dataset", "kind"]
    lowest = kept.groupBy(*kinds).agg(F.min("id").alias("first"))
    second = kept.join(lowest, kinds).where(F.col("id") > F.col("first")).groupBy(*kinds).agg(F.min("id").alias("second"))
    two = F.filter(F.array("first", "second"), lambda i: i.isNotNull())
    each = lowest.join(second, kinds, "left").select("dataset", F.col("kind").alias("_kind"), F.explode(two).alias("_id"))
    listed = each.groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("_id", "_kind"))).alias("_low"))
    fits = lambda e: (F.col("kind") == 0) | (e["_kind"] != F.col("kind"))
    usable = F.filter("_low", (lambda e: fits(e) & (e["_id"] != F.col("id"))) if skip_same_id else fits)
    match = F.get(usable, F.lit(0))["_id"].alias("match_id")
    return asked.drop("vec").join(listed, "dataset").select("dataset", "id", match, F.lit(0.0).alias("similarity")).where(F.col("match_id").isNotNull())
