"""Trimming and exact rounding."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def table(values: dict, kind: str = "string") -> Column:
    """A constant map, which the optimizer folds into one literal however many entries it has."""
    return F.from_json(F.lit(json.dumps(values)), f"map<string,{kind}>")


def trimmed(c: Column) -> Column:
    """Without white space at either end, that of Unicode too."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """Trimmed; null if nothing is left."""
    t = trimmed(c)
    return F.when(t != "", t)


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c computed once and standing once in the plan, however often it is used."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _rounded(v: Column, k: float) -> Column:
    split = 134_217_729.0
    q = v * F.lit(k)
    v_hi = F.lit(split) * v - (F.lit(split) * v - v)
    k_hi = split * k - (split * k - k)
    v_lo, k_lo = v - v_hi, F.lit(k - k_hi)
    error = ((v_hi * F.lit(k_hi) - q) + v_hi * k_lo + v_lo * F.lit(k_hi)) + v_lo * k_lo
    low = F.floor(q).cast("double")
    over = (q - low - F.lit(0.5)) + error
    even = F.when(F.pmod(low, F.lit(2.0)) == 0, low).otherwise(low + 1)
    return F.when(over > 0, low + 1).when(over < 0, low).otherwise(even) / F.lit(k)


def rounded(c: Column, k: float = 10_000.0) -> Column:
    """A double that is not negative, rounded at the fourth place by its exact value, halves to even.

    The product with k is split into the nearest double and its error (Dekker), so no second rounding can tip a value over.
    """
    return once(c.cast("double"), lambda v: _rounded(v, k))
