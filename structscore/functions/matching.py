"""Tolerant matching of two triple lists and the thirteen scores made from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, python_repr

# Edit distance of names and relative error of numbers, per tolerance.
TOLERANCES = {"strict": (0, 0.0), "slight": (2, 0.05), "high": (5, 0.1)}
LOOSE_TOLERANCES = {"strict": (0, 0.1), "slight": (2, 0.3), "high": (5, 0.5)}

# The ten thresholds of the averaged score, with the drift that stepping by 0.05 has.
THRESHOLDS = [
    0.5, 0.55, 0.6000000000000001, 0.6500000000000001, 0.7000000000000002,
    0.7500000000000002, 0.8000000000000003, 0.8500000000000003, 0.9000000000000004, 0.9500000000000004,
]

METRICS = ["em", "map_strict", "map_slight", "map_high"] + [f"ap_{t}_{n}" for n in TOLERANCES for t in (50, 75, 90)]


def _joined(t: Column) -> Column:
    return F.concat(t["k0"], t["k1"], F.when(t["num"].isNotNull(), python_repr(t["num"])).otherwise(F.coalesce(t["txt"], F.lit(""))))


def matches(p: Column, r: Column, words: int, error: float) -> Column:
    """One predicted triple fits one of the reference.

    Numbers: names within `words` edits, relative error within `error`.  The
    error is divided by the reference value with its sign, so any number fits a
    negative reference value.  Otherwise the whole triple is within `words`.
    """

    def near(a: Column, b: Column) -> Column:
        return F.levenshtein(a, b, words) >= 0 if words else a == b

    numbers = p["num"].isNotNull() & r["num"].isNotNull()
    names = near(F.concat(p["k0"], p["k1"]), F.concat(r["k0"], r["k1"]))
    off = F.try_divide(F.abs(p["num"] - r["num"]), r["num"] + 0.000001)
    close = ~F.isnan(off) & (off <= error)  # first: it is cheap and mostly false
    return F.coalesce(F.when(numbers, close & names).otherwise(near(_joined(p), _joined(r))), F.lit(False))


def similarity(pred: Column, ref: Column, words: int, error: float) -> Column:
    """Matched predictions over the union that doesn't count them twice; it may exceed 1.

    |E| / (|P or R| - |E| + |E and P and R|); an empty union gives 0.
    """

    def of(p: Column, r: Column) -> Column:
        found = F.filter(p, lambda a: F.exists(r, lambda b: matches(a, b, words, error)))
        return let(
            found,
            lambda e: F.coalesce(
                F.try_divide(
                    F.size(e).cast("double"),
                    (F.size(F.array_union(p, r)) - F.size(e) + F.size(F.array_intersect(e, F.array_intersect(p, r)))).cast("double"),
                ),
                F.lit(0.0),
            ),
        )

    return let(F.array_distinct(pred), lambda p: let(F.array_distinct(ref), lambda r: of(p, r)))


def averaged(sim: Column) -> Column:
    """A tenth for each threshold passed, added from the left."""
    out = F.lit(0.0)
    for t in THRESHOLDS:
        out = out + F.when(sim >= t, 1.0).otherwise(0.0) / 10
    return out


def scores(sims: dict[str, Column]) -> Column:
    """struct of the thirteen scores of one row, from its similarity per tolerance."""
    at = lambda s, t: F.when(s >= t, 1.0).otherwise(0.0)
    out = {"em": at(sims["strict"], 1.0)}
    out |= {f"map_{n}": averaged(s) for n, s in sims.items()}
    out |= {f"ap_{round(100 * t)}_{n}": at(s, t) for n, s in sims.items() for t in (0.5, 0.75, 0.9)}
    return F.struct(*[out[m].alias(m) for m in METRICS])


def zero_scores() -> Column:
    return F.struct(*[F.lit(0.0).alias(m) for m in METRICS])
