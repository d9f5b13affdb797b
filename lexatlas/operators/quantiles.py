"""Exact percentiles over many tasks: order statistics by narrowing value ranges."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of a range that may be looked at one by one, and the accuracy of the sketch that proposes ranges.
FEW, ACCURACY = 10_000, 2_000


def order_statistics(values: DataFrame, column: str, positions: Sequence[int], count: int) -> dict[int, float]:
    """The values at ``positions`` (from 0) of the ascending order; ``count`` non-null finite doubles in all.

    A sketch proposes a range of values around each position; a second pass
    counts exactly what lies below and inside. Ranges that hold few values, or
    one, end the search, others are narrowed again. Nothing but counts and
    the few values of ended ranges leaves the tasks.
    """
    v = F.col(column)
    found: dict[int, float] = {}
    # position -> (low, high, values below low, values inside, slack of the next proposal); ranges are closed on both sides
    open_: dict[int, tuple[float, float, int, int, float]] = {p: (-math.inf, math.inf, 0, count, 2.0) for p in set(positions)}
    while open_:
        sketches, counts, ended = [], [], {}
        for p, (low, high, below, inside, slack) in open_.items():
            share, width = (p - below + 0.5) / inside, slack / ACCURACY + 1.0 / inside
            here = F.when((v >= low) & (v <= high), v)
            sketches.append(F.percentile_approx(here, F.array(F.lit(max(0.0, share - width)), F.lit(min(1.0, share + width))), ACCURACY).alias(f"s{p}"))
        proposed = values.agg(*sketches).first()
        for p in open_:
            low, high = proposed[f"s{p}"]
            ends = [F.count(F.when(v == end, 1)).alias(f"{name}{p}") for name, end in (("l", low), ("h", high))]
            counts += [F.count(F.when(v < low, 1)).alias(f"b{p}"), F.count(F.when((v >= low) & (v <= high), 1)).alias(f"i{p}"), *ends]
        told = values.agg(*counts).first()
        for p, (old_low, old_high, old_below, old_inside, slack) in list(open_.items()):
            (low, high), below, inside = proposed[f"s{p}"], told[f"b{p}"], told[f"i{p}"]
            if not below <= p < below + inside:  # the sketch was off by more than it says: ask for a wider range
                if slack > 4 * ACCURACY:
                    raise RuntimeError(f"no range found for position {p}")
                open_[p] = (old_low, old_high, old_below, old_inside, 4 * slack)
            elif p < below + told[f"l{p}"]:  # among the values equal to an end, of which there may be any number
                found[p] = low
                del open_[p]
            elif p >= below + inside - told[f"h{p}"]:
                found[p] = high
                del open_[p]
            else:
                low, high, below = math.nextafter(low, math.inf), math.nextafter(high, -math.inf), below + told[f"l{p}"]
                inside -= told[f"l{p}"] + told[f"h{p}"]
                if inside <= FEW:
                    ended[p] = (low, high, below)
                    del open_[p]
                else:
                    open_[p] = (low, high, below, inside, slack)
        if ended:
            wanted = F.lit(False)
            for low, high, _ in ended.values():
                wanted = wanted | ((v >= low) & (v <= high))
            some = sorted((r["value"], r["n"]) for r in values.where(wanted).groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n")).collect())  # FEW a range
            for p, (low, high, below) in ended.items():
                for value, n in some:
                    if low <= value <= high:
                        if p < below + n:
                            found[p] = value
                            break
                        below += n
    return found


def percentiles(values: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Linearly interpolated percentiles (NUM-11) of the non-null values; nulls for an empty table."""
    sound = values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias(column))
    count = sound.count()
    if not count:
        return [None] * len(shares)
    places = [s * (count - 1) for s in shares]
    needed = {p for place in places for p in (math.floor(place), math.ceil(place))}
    at = order_statistics(sound, column, sorted(needed), count)
    out = []
    for place in places:
        low, high = at[math.floor(place)], at[math.ceil(place)]
        out.append(low + (place - math.floor(place)) * (high - low))
    return out
