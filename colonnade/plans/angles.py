"""Blocks of vectors around pivots, with bounds on the angles between their cells.

The angle between two vectors is a metric.  Vectors of one dataset and length lie in the cell of their
nearest pivot, and neighbouring cells together make blocks of bounded size.  From the angle of two pivots
and the least and greatest angles of the cells' members to them follows the least angle that members of two
cells can have, so cells whose bound is above all angles already found need no comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colonnade.plans.scale import materialize

#: Most pivots of one dataset and vector length, vectors looked at for each, and what a bound may be above an angle found, for rounding.
PIVOTS = 2048
SAMPLE = 4
SLACK = 1e-6
#: Angles are counted in bins of this part of a radian; vectors that one task places, in blocks; query cells that one task bounds.
BINS = 512
PLACED = 8
BOUNDED = 2048

_GROUP = ["dataset", "kind"]
_CELL = ["dataset", "kind", "block", "cell"]


def vectors(df: DataFrame, dataset: str, id_: str, vector: str) -> DataFrame:
    """dataset, id, vec and kind: the length of a vector with a direction, 0 for one of zeros or with a null or non-finite entry.

    Rows without a dataset, an id or a vector are left out.
    """
    vec = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{dataset}`").alias("dataset"), F.col(f"`{id_}`").alias("id"), vec.alias("vec")).dropna()
    squares = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x * x)
    return rows.withColumn("kind", F.when((squares > 0) & (squares < float("inf")), F.size("vec")).otherwise(0))


def pivots(stored: DataFrame, block: int) -> DataFrame:
    """Pivots of every dataset and length, far apart from each other: four for each root of its vectors, ``PIVOTS`` at most.

    Of ``SAMPLE`` times as many vectors, chosen by a hash of their id, each pivot is the one farthest from those
    before it, so the first few pivots spread over all; the nearest of them says which block a cell goes to.
    Which vectors are pivots changes what is compared, never what is found.  Returns dataset, kind, pivots
    (an array of vectors) and home (of every pivot, the place of that near one).
    """
    rows = stored.where("kind > 0").withColumn("hash", F.xxhash64("id"))
    sizes = rows.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("_n"), F.min("hash").alias("_least"))
    sizes = sizes.withColumn("wanted", F.least(F.ceil(4 * F.sqrt("_n")), F.lit(PIVOTS)).cast("int")).withColumn("blocks", F.ceil(F.col("_n") / block))
    step = F.greatest(F.floor(F.col("_n") / (SAMPLE * F.col("wanted"))).cast("long"), F.lit(1).cast("long"))
    some = (F.col("hash") == F.col("_least")) | (F.pmod("hash", step) == 0)
    once = rows.join(sizes, _GROUP).where(some).groupBy(*_GROUP, "hash", "wanted", "blocks").agg(F.min("vec").alias("vec"))

    def spread(group: pd.DataFrame) -> pd.DataFrame:
        own = unit(group.sort_values("hash")["vec"])
        chosen, nearest = [0], own @ own[0]
        while len(chosen) < group["wanted"].iloc[0] and nearest.min() < 1 - 1e-12:
            chosen.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, own @ own[chosen[-1]])
        centres = own[chosen]
        home = (centres @ centres[: group["blocks"].iloc[0]].T).argmax(axis=1)
        return group[["dataset", "kind"]].head(1).assign(pivots=[[v.tolist() for v in centres]], home=[home.tolist()])

    schema = f"dataset {dict(stored.dtypes)['dataset']}, kind int, pivots array<array<double>>, home array<int>"
    return once.groupBy(*_GROUP).applyInPandas(spread, schema)


def unit(cells: pd.Series) -> np.ndarray:
    matrix = np.array([np.asarray(v, float) for v in cells])
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def placed(rows: DataFrame, around: DataFrame, block: int) -> DataFrame:
    """dataset, kind, block, cell, angle (to the cell's pivot), id and vec of the vectors whose dataset and length have pivots.

    A block holds about ``block`` vectors, of cells with one home: vectors are counted by cell and bin of
    angles, these are put in a row and cut, and a bin of many equal angles is dealt over several blocks.
    """
    rows = rows.where("kind > 0")
    counted = rows.groupBy(*_GROUP).agg(F.ceil(F.count(F.lit(1)) / (PLACED * block)).cast("long").alias("_parts"))
    sent = around.join(counted, _GROUP)
    left = rows.join(counted, _GROUP).select(*_GROUP, F.pmod(F.xxhash64("id", "vec"), F.col("_parts")).alias("part"), "id", "vec")
    right = sent.select(*_GROUP, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("part"), "pivots", "home")
    right = right.select(*(F.col(c).alias(c) for c in right.columns))

    def place(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if b.empty:  # a dataset or length without stored vectors
            a = a[:0]
        centres = unit(b["pivots"].iloc[0]) if len(a) else None
        home = np.asarray(b["home"].iloc[0], np.int32) if len(a) else np.zeros(1, np.int32)
        cell, angle = np.zeros(len(a), np.int32), np.zeros(len(a))
        for k in range(0, len(a), 2048):
            cosines = unit(a["vec"].iloc[k : k + 2048]) @ centres.T
            cell[k : k + 2048] = cosines.argmax(axis=1)
            angle[k : k + 2048] = np.arccos(np.clip(cosines.max(axis=1), -1, 1))
        out = a[["dataset", "kind", "id", "vec"]].assign(home=home[cell], cell=cell, angle=angle, spread=np.arange(len(a)))
        return out[["dataset", "kind", "home", "cell", "angle", "spread", "id", "vec"]]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"dataset {kinds['dataset']}, kind int, home int, cell int, angle double, spread long, id {kinds['id']}, vec array<double>"
    keys = [*_GROUP, "part"]
    found = materialize(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(place, schema))
    found = found.withColumn("_bin", F.floor(F.col("angle") * BINS).cast("int"))
    home = [*_GROUP, "home"]
    bins = found.groupBy(*home, "cell", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = bins.withColumn("_before", F.sum("_n").over(Window.partitionBy(*home).orderBy("cell", "_bin")) - F.col("_n"))
    piece = F.floor((F.col("_before") + F.pmod(F.xxhash64("spread"), F.col("_n"))) / block).cast("long")
    return found.join(before, [*home, "cell", "_bin"]).withColumn("block", F.shiftleft(F.col("home").cast("long"), 40) + piece).select(*_CELL, "angle", "id", "vec")


def cells(rows: DataFrame, *more) -> DataFrame:
    """One row for each cell of a block: the least and the greatest angle to its pivot."""
    return rows.groupBy(*_CELL).agg(F.min("angle").alias("low"), F.max("angle").alias("high"), *more)


def bounds(theta: np.ndarray, low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """The least angle between members of cells whose pivots are ``theta`` apart."""
    far = theta - high - other_high
    inside, outside = other_low - theta - high, low - theta - other_high
    return np.maximum(np.maximum(far, 0), np.maximum(inside, outside))


def near_cells(asking: DataFrame, stored: DataFrame, around: DataFrame, first: bool) -> DataFrame:
    """For query cells the stored cells that may hold something nearer, by stored block.

    ``first``: the block of the cell most likely to be near, without its cells.  Otherwise every block with
    cells whose bound is not above the query cell's column ``reach``, but not its ``first_block``; ``near``
    lists these cells with theta, the angle of the pivots, low and high.  Query cells of a dataset are dealt
    over tasks; each sees one row for every stored cell.
    """
    dealt = asking.groupBy(*_GROUP).agg(F.ceil(F.count(F.lit(1)) / BOUNDED).cast("long").alias("_parts"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("part")
    left = asking.join(dealt, _GROUP).withColumn("part", F.pmod(F.xxhash64("block", "cell"), F.col("_parts"))).drop("_parts")
    centres = around.select(*_GROUP, F.lit(-1).cast("long").alias("block"), F.lit(-1).alias("cell"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), "pivots")
    kept = stored.select(*_CELL, "low", "high").withColumn("pivots", F.lit(None).cast("array<array<double>>"))
    right = kept.unionByName(centres).join(dealt, _GROUP).select(*_CELL, "low", "high", "pivots", each)
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # columns of its own: both sides may come from one table

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = list(_pairs(a, b, first)) if len(a) and len(b) else []
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=_PAIR)

    kind = dict(asking.dtypes)["dataset"]
    schema = f"dataset {kind}, kind int, block long, cell int, other_block long, other_cell int, theta double, low double, high double"
    keys = [*_GROUP, "part"]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, schema)
    if first:
        return pairs.select(*_CELL, "other_block")
    return pairs.groupBy(*_CELL, "other_block").agg(F.collect_list(F.struct("other_cell", "theta", "low", "high")).alias("near"))


_PAIR = ["dataset", "kind", "block", "cell", "other_block", "other_cell", "theta", "low", "high"]


def _pairs(a: pd.DataFrame, b: pd.DataFrame, first: bool) -> Iterator[pd.DataFrame]:
    centres = unit(b.loc[b["cell"] < 0, "pivots"].iloc[0])
    b = b[b["cell"] >= 0].sort_values(["block", "cell"], ignore_index=True)
    b_low, b_high = b["low"].to_numpy(), b["high"].to_numpy()
    step = max(1, 4_000_000 // max(1, len(b)))
    for k in range(0, len(a), step):
        some = a.iloc[k : k + step]
        low, high = some["low"].to_numpy()[:, None], some["high"].to_numpy()[:, None]
        cosines = centres[some["cell"].to_numpy()] @ centres[b["cell"].to_numpy()].T
        theta = np.arccos(np.clip(cosines, -1, 1))
        least = bounds(theta, low, high, b_low[None, :], b_high[None, :])
        if first:
            i, j = np.arange(len(some)), (least * 1000 + theta + np.abs((low + high) / 2 - (b_low + b_high) / 2)).argmin(axis=1)
        else:
            open_ = (least <= some["reach"].to_numpy()[:, None] + SLACK) & (some["first_block"].to_numpy()[:, None] != b["block"].to_numpy()[None, :])
            i, j = np.nonzero(open_)
        pairs = some[["dataset", "kind", "block", "cell"]].iloc[i].reset_index(drop=True)
        other = b[["block", "cell", "low", "high"]].iloc[j].reset_index(drop=True)
        yield pairs.assign(other_block=other["block"], other_cell=other["cell"], theta=theta[i, j], low=other["low"], high=other["high"])[_PAIR]
