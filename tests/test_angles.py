from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade.operators import similarity
from colonnade.plans import angles
from colonnade.plans.scale import materialize


def plain(vectors: dict, ids: list, skip: bool = True) -> dict:
    """Best match of every id by all cosines; equal vectors have equal cosines."""
    m = np.array([vectors[i] for i in ids])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for k, i in enumerate(ids):
        score = np.einsum("ij,j->i", m, m[k])
        if skip:
            score[k] = -2
        top = np.flatnonzero(score >= score.max() - 1e-12)
        out[i] = (min(ids[t] for t in top), score.max())
    return out


def clusters(rng: np.random.Generator, centres: int, each: int, dim: int, width: float) -> np.ndarray:
    middle = rng.normal(size=(centres, dim))
    return np.repeat(middle, each, axis=0) + width * rng.normal(size=(centres * each, dim))


def frame(spark, rows: list):
    return spark.createDataFrame(rows, "id long, d string, v array<double>")


@pytest.mark.parametrize("kind", ["clusters", "all directions", "one vector"])
def test_best_match_of_all(spark, kind):
    rng = np.random.default_rng(5)
    if kind == "clusters":
        m = clusters(rng, 12, 50, 8, 0.05)
    elif kind == "all directions":
        m = rng.normal(size=(500, 6))
    else:  # a third of all rows is one vector: the ring is dealt over several blocks
        m = np.concatenate((np.tile([1.0, 2.0, 3.0, 4.0], (200, 1)), rng.normal(size=(400, 4))))
    ids = [int(i) for i in rng.permutation(len(m))]
    vectors = dict(zip(ids, m, strict=True))
    df = frame(spark, [(i, "a", [float(x) for x in v]) for i, v in vectors.items()])
    found = similarity.best_matches(df, df, "d", "id", "id", "v", skip_same_id=True, block=40).collect()
    want = plain(vectors, ids)
    assert len(found) == len(ids)
    for r in found:
        assert r.match_id == want[r.id][0] and r.similarity == pytest.approx(want[r.id][1], abs=1e-9)


def test_two_tables(spark):
    rng = np.random.default_rng(6)
    stored, asked = clusters(rng, 5, 60, 5, 0.1), clusters(np.random.default_rng(6), 5, 12, 5, 0.2)
    left = frame(spark, [(1000 + i, "a", v.tolist()) for i, v in enumerate(asked)] + [(9, "none", [1.0] * 5), (8, None, [1.0] * 5), (7, "a", [1.0, None, 1.0, 1.0, 1.0]), (6, "a", [])])
    right = frame(spark, [(i, "a", v.tolist()) for i, v in enumerate(stored)] + [(900, "a", [1.0, 2.0]), (901, "b", [1.0] * 5)])
    found = {r.id: r for r in similarity.best_matches(left, right, "d", "id", "id", "v", 0.9, block=25).collect()}
    unit = [m / np.linalg.norm(m, axis=1, keepdims=True) for m in (asked, stored)]
    cosines = unit[0] @ unit[1].T
    for k in range(len(asked)):
        assert found[1000 + k].match_id == cosines[k].argmax() and found[1000 + k].hit == (cosines[k].max() >= 0.9)
    assert found[9].match_id is None and found[8].match_id is None
    assert all((found[i].match_id, found[i].similarity, found[i].hit) == (0, 0.0, False) for i in (6, 7))  # no direction


def test_cosine_zero_beats_a_negative_one(spark):
    df = frame(spark, [(1, "a", [1.0, 0.0]), (2, "a", [-1.0, 0.0]), (3, "a", [1.0]), (4, "a", [0.0, 0.0])])
    found = {r.id: (r.match_id, r.similarity) for r in similarity.best_matches(df, df, "d", "id", "id", "v", skip_same_id=True).collect()}
    assert found == {1: (3, 0.0), 2: (3, 0.0), 3: (1, 0.0), 4: (1, 0.0)}
    nothing = frame(spark, [])
    assert similarity.best_matches(nothing, df, "d", "id", "id", "v").count() == 0
    assert [r.match_id for r in similarity.best_matches(df, nothing, "d", "id", "id", "v").collect()] == [None] * 4


def test_bounds_hold():
    rng = np.random.default_rng(7)
    for _ in range(200):
        p, a, b = rng.normal(size=(2, 4)), clusters(rng, 1, 9, 4, 0.4), clusters(rng, 1, 9, 4, 0.4)
        p, a, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (p, a, b))
        to_own = [np.arccos(np.clip(m @ c, -1, 1)) for m, c in ((a, p[0]), (b, p[1]))]
        theta = np.arccos(np.clip(p[0] @ p[1], -1, 1))
        least = angles.bounds(theta, to_own[0].min(), to_own[0].max(), to_own[1].min(), to_own[1].max())
        assert least <= np.arccos(np.clip(a @ b.T, -1, 1)).min() + angles.SLACK


def shares(spark, m: np.ndarray, block: int) -> tuple[int, int, float]:
    """Blocks, the vectors of the largest, and the share of all pairs of vectors that both rounds compare."""
    df = frame(spark, [(i, "a", v.tolist()) for i, v in enumerate(m)])
    kept = angles.vectors(df, "d", "id", "v")
    around = materialize(angles.pivots(kept, block))
    rows = angles.placed(kept, around, block)
    cells = angles.cells(rows)
    first = angles.near_cells(angles.cells(rows), cells, around, True)
    seeded = materialize(similarity._compared(rows, rows, first, True)).withColumn("own", F.coalesce(F.acos("similarity"), F.lit(4.0)))
    asking = angles.cells(seeded, F.max("own").alias("reach"), F.first("other_block").alias("first_block"))
    rest = angles.near_cells(asking, cells, around, False)
    products = 0
    for sides in (similarity._sides(rows, rows, first), similarity._sides(seeded.select(*similarity._PLACED, "own"), rows, rest)):
        counts = [side.groupBy(*similarity._KEYS).count() for side in sides]
        both = counts[0].join(counts[1].withColumnRenamed("count", "others"), similarity._KEYS)
        products += both.agg(F.coalesce(F.sum(F.col("count") * F.col("others")), F.lit(0))).first()[0]
    sizes = [r["count"] for r in rows.groupBy("block").count().collect()]
    assert sum(sizes) == len(m)
    return len(sizes), max(sizes), products / len(m) ** 2


def test_most_pairs_are_never_compared(spark):
    n, largest, share = shares(spark, clusters(np.random.default_rng(8), 100, 20, 16, 0.05), 50)
    assert n >= 40 and largest <= 100
    assert share <= 0.1


def test_no_block_is_large(spark):
    m = np.concatenate((np.tile([1.0, 2.0, 3.0], (900, 1)), np.random.default_rng(9).normal(size=(900, 3))))
    n, largest, _ = shares(spark, m, 100)
    assert n >= 18 and largest <= 200
