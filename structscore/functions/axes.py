"""Positions on one axis: values between ticks, and the nearest label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Ticks nearer than this are one.
SAME = 1e-6


def interpolated(x: Column, ticks: Column) -> Column:
    """The value at `x` on a piecewise-linear axis of struct<at, value> ticks; the end pieces go on beyond it.

    Ticks may come in any order; of those at one place the first counts.  Null
    with fewer than two.
    """

    def read(sorted_: Column) -> Column:
        start = F.slice(sorted_, 1, 1)
        apart = F.aggregate(sorted_, start, lambda kept, t: F.when(t["at"] - F.element_at(kept, -1)["at"] > SAME, F.array_append(kept, t)).otherwise(kept))
        return F.when(F.size(sorted_) > 0, let(apart, on_piece))

    def on_piece(t: Column) -> Column:
        last = F.size(t) - 2
        i = F.greatest(F.least(F.size(F.filter(t, lambda p: p["at"] <= x)) - 1, last), F.lit(0))
        a, b = F.get(t, i), F.get(t, i + 1)
        return F.when(F.size(t) >= 2, a["value"] + (b["value"] - a["value"]) * (x - a["at"]) / (b["at"] - a["at"]))

    return let(F.array_sort(ticks), read)


def nearest(x: Column, positions: Column, most: float | None = None) -> Column:
    """The position nearest to `x`, the lower of two; null beyond a distance of `most`."""
    best = F.array_min(F.transform(positions, lambda p: F.struct(F.abs(p - x).alias("off"), p.alias("at"))))
    return best["at"] if most is None else F.when(best["off"] <= most, best["at"])
