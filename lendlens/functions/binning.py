"""Equal-width bins whose edges are computed once as lower + i * step."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _edge(lower: Column, step: Column, i: Column) -> Column:
    return i * step + lower


def equal_width_bin(value: Column, lower: Column, upper: Column, bins: int,
                    right_closed: bool) -> Column:
    """Number of inner edges below the value (or up to it, when bins are left-closed).

    The quotient gives the bin up to one place; comparing with the two edges next
    to it makes the answer exact without testing all edges.
    """
    step = (upper - lower) / F.lit(float(bins))
    guess = F.coalesce(F.floor(F.try_divide(value - lower, step)), F.lit(0)).cast("double")
    if right_closed:
        found = (guess + (_edge(lower, step, guess + 1) < value).cast("int")
                 - (_edge(lower, step, guess) >= value).cast("int"))
    else:
        found = (guess + (_edge(lower, step, guess + 1) <= value).cast("int")
                 - (_edge(lower, step, guess) > value).cast("int"))
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), found.cast("int")))
