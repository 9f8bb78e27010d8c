"""Exact quantiles of every position of wide feature arrays, by sketches that close in on them.

A pass over the rows sketches, for each position and quantile, the values between two values known to
enclose the quantile, and counts what lies below. The sketch proposes a narrower pair. Once no more
values lie between than the sketch keeps, it holds them all and the quantile is read off. Only sketches
and counts are shuffled, never values; the driver holds a few numbers for each position and quantile.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64  # positions that one row of sketches holds
SKETCH = 1024
# Half as much again as the sketch's rank error, so that a proposed pair seldom misses its quantile. A
# miss costs a pass, not the result.
MARGIN = 1.5 * 2.3 / SKETCH**0.9
# Sketches are only asked at fixed ranks: twice as many as a sketch keeps values, so that one of them falls
# to each value of a sketch that holds them all.
GRID = 2 * SKETCH


@dataclass
class _Search:
    """One quantile of one position: the pair that the next pass looks at, and an outer pair that is
    known to enclose the quantile."""

    rank: int | None = None
    low: float = -math.inf
    high: float = math.inf
    outer_low: float = -math.inf
    outer_high: float = math.inf
    found: float | None = None
    done: bool = False

    def narrow(self, below: int, at_low: int, between: int, at_high: int, pair: tuple[float, float] | None) -> None:
        """What a pass has counted; `pair` is what the sketch proposes, of two equal values the quantile."""
        up_to_low, up_to_between = below + at_low, below + at_low + between
        if below < self.rank <= up_to_low:
            self.found, self.done = self.low, True
        elif up_to_low < self.rank <= up_to_between:
            self.outer_low, self.outer_high = self.low, self.high
            self.low, self.high = pair
            if between <= SKETCH:
                self.found, self.done = pair[0], True
        elif up_to_between < self.rank <= up_to_between + at_high:
            self.found, self.done = self.high, True
        elif self.rank <= below:
            self.low, self.high = self.outer_low, self.low
            self.outer_high = self.high
        elif self.high < self.outer_high:
            self.low, self.high = self.high, self.outer_high
            self.outer_low = self.low
        else:
            # More values than all that can be compared: the rest are not numbers, which rank highest.
            self.found, self.done = math.nan, True


def _constant(values: Sequence[float]) -> Column:
    texts = ["NaN" if math.isnan(v) else repr(v) for v in values]
    return F.split(F.lit(",".join(texts).replace("inf", "Infinity")), ",").cast("array<double>")


def _pass(rows: DataFrame, width: int, brackets: list[list[tuple[float, float]]], shares: Sequence[float]) -> list:
    """One scan: for each position and bracket (low, high) the counts below, at and between its bounds, and
    for each share its rank among all values and a narrower pair of values for it."""
    block = min(BLOCK, width)
    per = max(len(of) for of in brackets)
    # Places without a bracket have bounds that are no numbers: nothing is below or between them.
    filled = [of + [(math.nan, math.nan)] * (per - len(of)) for of in brackets]
    size = block * per
    flat = [bracket for of in filled for bracket in of]
    parts = [flat[i : i + size] for i in range(0, len(flat), size)]
    low, high = (F.array(*[_constant([b[side] for b in part]) for part in parts]) for side in (0, 1))
    cut = F.transform(
        F.sequence(F.lit(0), F.lit(len(parts) - 1)),
        lambda b: F.struct(
            b.alias("block"), F.slice("x", b * block + 1, block).alias("v"), F.get(low, b).alias("low"), F.get(high, b).alias("high")
        ),
    )
    sums, told = [], []
    for j in range(block):
        v = f"get(v, {j})"
        sums.append(f"count({v}) AS n_{j}")
        for slot in range(per):
            low, high, c = f"get(low, {j * per + slot})", f"get(high, {j * per + slot})", f"{j}_{slot}"
            asked = f"NOT isnan({low})"
            sums += [
                f"count_if({asked} AND {v} < {low}) AS below_{c}",
                f"count_if({asked} AND {v} = {low}) AS at_low_{c}",
                f"count_if({asked} AND {v} = {high} AND {high} <> {low}) AS at_high_{c}",
                f"kll_sketch_agg_double(if({asked} AND {v} > {low} AND {v} < {high}, {v}, NULL), {SKETCH}) AS sketch_{c}",
            ]
            told.append(
                f"named_struct('position', block * {block} + {j}, 'slot', {slot}, 'n', n_{j}, 'below', below_{c}, "
                f"'at_low', at_low_{c}, 'between', kll_sketch_get_n_double(sketch_{c}), 'at_high', at_high_{c}, "
                f"'sketch', sketch_{c})"
            )
    sketched = rows.select(F.inline(cut)).groupBy("block").agg(*map(F.expr, sums))
    cells = sketched.selectExpr(f"inline(array({', '.join(told)}))").where(f"position < {width} AND n > 0")
    wanted = _constant(list(shares))
    cells = cells.withColumn(
        "ranks", F.transform(wanted, lambda q: F.greatest(F.lit(1), F.ceil(q * F.col("n"))).cast("bigint"))
    )
    ranks = _constant([(i + 0.5) / GRID for i in range(GRID)])
    known = F.when(F.col("between") > 0, F.call_function("kll_sketch_get_quantile_double", F.col("sketch"), ranks))
    cells = cells.withColumn("known", known)
    margin = F.when(F.col("between") <= SKETCH, 0.0).otherwise(MARGIN)

    def pair(rank: Column) -> Column:
        # Middle of the rank's step.
        share = F.try_divide(rank - F.col("below") - F.col("at_low") - F.lit(0.5), F.col("between"))

        def value(at: Column) -> Column:
            place = F.round(F.greatest(F.lit(0.0), F.least(at, F.lit(1.0))) * GRID - 0.5).cast("int")
            return F.get("known", F.greatest(F.lit(0), F.least(place, F.lit(GRID - 1))))

        return F.struct(value(share - margin).alias("low"), value(share + margin).alias("high"))

    return cells.select(
        "position", "slot", "ranks", "below", "at_low", "between", "at_high", F.transform("ranks", pair).alias("pairs")
    ).collect()


def exact_quantiles(
    df: DataFrame, quantiles: Sequence[float], features: str = "features", width: int | None = None
) -> tuple[dict[int, list[float]], int]:
    """{position: the quantiles' values} and the width of the arrays, from a few scans of the rows.

    A quantile is the smallest value with at least that share of the values up to it. Missing values and
    positions that an array does not reach count for nothing, values that are not a number rank highest.
    Positions without values are left out. Each pass leaves about one value in seventy of those that
    are still between the bounds, whatever their distribution; each of them also drops its two bounds, so
    the search ends with any repetition of values. ``width`` spares the scan that finds it.
    """
    rows = df.select(F.col(features).cast("array<double>").alias("x"))
    if width is None:
        width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    shares = [float(q) for q in quantiles]
    if width <= 0 or not shares:
        return {}, max(0, width)
    searches = {p: [_Search() for _ in shares] for p in range(width)}
    while any(not s.done for of in searches.values() for s in of):
        brackets = [
            sorted({(s.low, s.high) for s in searches.get(p, []) if not s.done}) for p in range(width)
        ]
        told = {(r["position"], r["slot"]): r for r in _pass(rows, width, brackets, shares)}
        for p, of in list(searches.items()):
            for k, search in enumerate(of):
                if search.done:
                    continue
                r = told.get((p, brackets[p].index((search.low, search.high))))
                if r is None:  # no values at this position
                    del searches[p]
                    break
                search.rank = r["ranks"][k]
                pair = r["pairs"][k]
                search.narrow(r["below"], r["at_low"], r["between"], r["at_high"], (pair["low"], pair["high"]))
    return {p: [s.found for s in of] for p, of in searches.items()}, width
