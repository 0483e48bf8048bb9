"""Reproducible pseudo-random integers computed from column values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_below(bound: int, *parts: Column | str | int) -> Column:
    """Integer in ``[0, bound)`` from the MD5 of the colon-joined parts.

    A retried task yields the same rows, which ``rand()`` after a shuffle
    would not promise. Eight hex digits carry bounds up to 2**32.
    """
    if not 0 < bound <= 2**32:
        raise ValueError("bound must lie in 1..2**32")
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    digits = F.conv(F.substring(F.md5(text), 1, 8), 16, 10)
    return F.pmod(digits.cast("bigint"), F.lit(bound))


def hashes_below(bounds: Sequence[int], *parts: Column | str | int) -> list[Column]:
    """An integer in ``[0, bound)`` for each of ``bounds``, all from one MD5 of the colon-joined parts.

    Fifteen hex digits make a 60-bit number; each integer is the remainder by
    its bound of what the bounds before it leave.
    """
    if not all(0 < b for b in bounds) or math.prod(bounds) > 2**52:
        raise ValueError("the bounds must be positive and their product at most 2**52")
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    left = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    out, before = [], 1
    for bound in bounds:
        # Dividing whole numbers below 2**60 as decimals or doubles would round; "div" does not.
        out.append(F.pmod(F.call_function("div", left, F.lit(before)), F.lit(bound)))
        before *= bound
    return out
