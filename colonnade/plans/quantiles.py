"""Exact quantiles that never gather a column's values in one task.

Spark's own exact ``percentile`` keeps one counter per distinct value in a single
aggregation buffer.  Here every wanted rank starts with the bracket from the column's
smallest to its largest value.  A sketch over a random sample proposes a narrower
bracket, and a counting pass over all rows accepts it only if it holds the rank, so
the sample decides the cost and never the answer.  Rows inside the final brackets are
grouped by value.  Hot values are cheap: a rank among the copies of a bracket end is
answered by the counts alone.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colonnade.functions.columns import col
from colonnade.plans.scale import materialize, read_repeatedly, with_running_sum

SKETCH_ACCURACY = 2000
#: Rows a sketch looks at, on average, and the rank error allowed for it (over four deviations).
SAMPLE_ROWS = 40_000
SAMPLE_MARGIN = 0.0125
#: A column with at most this many values needs no sketch.
DIRECT_ROWS = 100_000
#: A bracket with at most this many rows is resolved by sorting its value counts in one task.
BRACKET_ROWS = 1_000_000
MAX_PASSES = 12


@dataclass
class _Slot:
    """One wanted quantile: the ranks it needs and the counted value bracket that holds them."""

    name: str
    prob: float
    first: int = 0
    last: int = 0
    low: float | None = None
    high: float | None = None
    below: int = 0
    inside: int = 0
    margin: float = SAMPLE_MARGIN
    stuck: bool = False
    answer: tuple[float, float] | None = None


def exact_quantiles(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], nearest: bool = False
) -> dict[str, list[float | None]]:
    """Quantiles of numeric columns, as driver-side numbers (two per wanted quantile at most).

    Linear interpolation by default; ``nearest`` takes the value at rank ``ceil(p * n)``.
    Columns without values answer ``None``.
    """
    names = [name for name, probs in wanted.items() if probs]
    if not names:
        return {name: [] for name in wanted}
    frame = df.select(*[F.nullif(col(n).cast("double"), F.lit(float("nan"))).alias(n) for n in names])
    slots = [_Slot(name, p) for name in names for p in wanted[name]]
    with read_repeatedly(frame) as held:
        counts = _search(held, names, slots, nearest)

    result: dict[str, list[float | None]] = {name: [] for name in wanted}
    for slot in slots:
        n = counts[slot.name]
        if n == 0:
            result[slot.name].append(None)
            continue
        low, high = slot.answer
        weight = 0.0 if nearest else (n - 1) * slot.prob - slot.first
        result[slot.name].append(low + (high - low) * weight)
    return result


def _search(frame: DataFrame, names: list[str], slots: list[_Slot], nearest: bool) -> dict[str, int]:
    """Give every slot its answer; returns the number of values per column."""
    counts = _whole_range(frame, names, slots, nearest)
    for attempt in range(MAX_PASSES):
        limit = DIRECT_ROWS if attempt == 0 else BRACKET_ROWS
        wide = [s for s in slots if s.answer is None and not s.stuck and s.inside > limit]
        if not wide:
            break
        _narrow(frame, wide)
    _resolve(frame, [s for s in slots if s.answer is None and s.inside])
    return counts


def _whole_range(frame: DataFrame, names: list[str], slots: list[_Slot], nearest: bool) -> dict[str, int]:
    """Count the values and start every slot with the bracket from smallest to largest."""
    parts = {"n": F.count, "low": F.min, "high": F.max}
    row = frame.agg(*[f(col(c)).alias(f"{tag}{i}") for i, c in enumerate(names) for tag, f in parts.items()]).first()
    counts = {name: row[f"n{i}"] for i, name in enumerate(names)}
    for slot in slots:
        i, n = names.index(slot.name), counts[slot.name]
        if not n:
            continue
        if nearest:
            slot.first = slot.last = min(max(math.ceil(n * slot.prob) - 1, 0), n - 1)
        else:
            slot.first, slot.last = math.floor((n - 1) * slot.prob), math.ceil((n - 1) * slot.prob)
        slot.low, slot.high, slot.inside = row[f"low{i}"], row[f"high{i}"], n
        if slot.low == slot.high:
            slot.answer = (slot.low, slot.low)
    return counts


def _narrow(frame: DataFrame, slots: list[_Slot]) -> None:
    """Propose a narrower bracket for each slot and adopt it where a full count confirms it."""
    shared: dict[tuple, list[_Slot]] = {}
    for s in slots:
        shared.setdefault((s.name, s.low, s.high), []).append(s)

    def ends(s: _Slot) -> tuple[float, float]:
        return (
            min(max((s.first - s.below) / s.inside - s.margin, 0.0), 1.0),
            min(max((s.last - s.below + 1) / s.inside + s.margin, 0.0), 1.0),
        )

    chance = {key: min(SAMPLE_ROWS / members[0].inside, 1.0) for key, members in shared.items()}
    drawn = frame.withColumn("__chance", F.rand()).where(F.col("__chance") < max(chance.values()))
    samples, sketches, probs = [], [], []
    for i, (key, members) in enumerate(shared.items()):
        name, low, high = key
        x = col(name)
        keep = x.between(low, high) & (F.col("__chance") < chance[key])
        probs.append(sorted({p for s in members for p in ends(s)}))
        samples.append(F.when(keep, x).alias(f"x{i}"))
        sketches.append(F.percentile_approx(f"x{i}", probs[-1], SKETCH_ACCURACY).alias(f"q{i}"))
    row = drawn.select(*samples).agg(*sketches).first()

    proposals = []
    for i, members in enumerate(shared.values()):
        at = dict(zip(probs[i], row[f"q{i}"] or []))
        for s in members:
            low, high = ends(s)
            # an outermost bracket end stays where it is: a sample need not contain the extremes
            proposals.append((s, at.get(low, s.low) if low > 0 else s.low, at.get(high, s.high) if high < 1 else s.high))

    ends_of = list(dict.fromkeys((s.name, v) for s, low, high in proposals for v in (low, high)))
    aggs = [f(col(c), v).alias(f"{tag}{i}") for i, (c, v) in enumerate(ends_of) for tag, f in (("lt", _under), ("le", _upto))]
    row = frame.agg(*aggs).first()
    span = {end: (row[f"lt{i}"], row[f"le{i}"]) for i, end in enumerate(ends_of)}
    for s, low, high in proposals:
        (below, upto_low), (under_high, upto) = span[s.name, low], span[s.name, high]
        if not (below <= s.first and s.last < upto):
            s.margin *= 4
            continue
        s.stuck = (low, high) == (s.low, s.high)  # a few hot values: counting them is all there is to do
        s.low, s.high, s.below, s.inside = low, high, below, upto - below
        # a rank among the rows equal to a bracket end needs no further look
        at_ends = [low if r < upto_low else high if r >= under_high else None for r in (s.first, s.last)]
        if None not in at_ends:
            s.answer = (at_ends[0], at_ends[1])


def _under(x: Column, bound: float) -> Column:
    return F.count_if(x < bound)


def _upto(x: Column, bound: float) -> Column:
    return F.count_if(x <= bound)


def _resolve(frame: DataFrame, slots: list[_Slot]) -> None:
    """Group the rows inside the brackets by value, and read the wanted ranks off the running counts."""
    if not slots:
        return
    names = list(dict.fromkeys(s.name for s in slots))
    near = {c: reduce(or_, [col(c).between(s.low, s.high) for s in slots if s.name == c]) for c in names}
    cells = F.array(*[F.when(near[c], F.struct(F.lit(i).alias("c"), col(c).alias("x"))) for i, c in enumerate(names)])
    values = (
        frame.where(reduce(or_, near.values()))
        .select(F.explode(cells).alias("cell"))
        .where(F.col("cell").isNotNull())
        .groupBy(F.col("cell.c").alias("c"), F.col("cell.x").alias("x"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # the values are counted by now; hand each to the brackets it is in
    brackets = list(dict.fromkeys((s.name, s.low, s.high, s.below) for s in slots))
    inside = [F.when((F.col("c") == names.index(c)) & F.col("x").between(low, high), F.lit(i)) for i, (c, low, high, _) in enumerate(brackets)]
    counted = values.select(F.explode(F.array(*inside)).alias("bracket"), "x", "n").where(F.col("bracket").isNotNull())
    if all(s.inside <= BRACKET_ROWS for s in slots):  # rows of a bracket are bounded, so a window is a bounded task
        ordered = Window.partitionBy("bracket").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = counted.withColumn("upto", F.sum("n").over(ordered))
    else:
        running = with_running_sum(materialize(counted), [F.col("x")], F.col("n"), "upto", by=["bracket"])

    place = {id(s): brackets.index((s.name, s.low, s.high, s.below)) for s in slots}
    wanted = sorted({(place[id(s)], rank - s.below) for s in slots for rank in (s.first, s.last)})
    holds = [(F.col("bracket") == b) & (F.col("upto") - F.col("n") <= r) & (r < F.col("upto")) for b, r in wanted]
    # one row per wanted rank at most
    found = running.where(reduce(or_, holds)).collect()

    def at(s: _Slot, rank: int) -> float:
        r = rank - s.below
        for f in found:
            if f["bracket"] == place[id(s)] and f["upto"] - f["n"] <= r < f["upto"]:
                return f["x"]
        raise RuntimeError(f"Values of '{s.name}' changed between passes; write the table before asking for quantiles.")

    for s in slots:
        s.answer = (at(s, s.first), at(s, s.last))


def grouped_median(df: DataFrame, keys: Sequence[str], metric: Column, out: str) -> DataFrame:
    """Exact median per key.

    Values are counted first, so hot keys and hot values are pre-aggregated, and the
    counted values of one key may lie in many range slices.
    """
    names = [col(k) for k in keys]
    missing = F.col("__x").isNull()
    counted = df.select(*names, metric.cast("double").alias("__x")).groupBy(*names, "__x").agg(F.count(F.lit(1)).alias("__n"))
    # missing values stay in with no weight, so that a key without values keeps a row
    counted = materialize(counted.withColumn("__n", F.when(missing, 0).otherwise(F.col("__n"))))
    running = with_running_sum(counted, [F.col("__x").asc_nulls_first()], F.col("__n"), "__upto", keys, "__size")
    before, upto = F.col("__upto") - F.col("__n"), F.col("__upto")
    first, last = F.floor((F.col("__size") - 1) / 2), F.ceil((F.col("__size") - 1) / 2)
    middle = running.where(((before <= first) & (first < upto)) | ((before <= last) & (last < upto)) | (F.col("__size") == 0))
    return middle.groupBy(*names).agg(((F.min("__x") + F.max("__x")) / 2).alias(out))
