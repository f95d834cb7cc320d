"""Right tail of a truncated Poisson distribution, and effect sizes of counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Log of the smallest positive double: a probability below it is 0.
UNDERFLOW = -745.2


def truncated_tail(z: np.ndarray, m: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """P(X >= z | X <= m) for X ~ Poisson(lam), NaN for a missing or negative lam.

    With U the sum of the terms from z to m and D of those below z, all relative to the
    term at z, it is U / (U + D): no factorials, no difference of tails. A series stops
    once its terms fall and are below 1e-17 of the sum. 1 if P(X <= m) is 0 in double
    precision or z <= 0; 0 if lam = 0 and z >= 1, or z > m.
    """
    z, m = np.floor(z.astype(float)), np.floor(m.astype(float))
    lam = lam.astype(float)
    out = np.full(len(z), np.nan)
    ok = (lam >= 0) & ~np.isnan(z) & ~np.isnan(m)
    out[ok & (z > m)] = 0.0
    out[ok & (lam == 0) & (z >= 1)] = 0.0
    out[ok & (z <= 0)] = 1.0
    todo = np.flatnonzero(ok & (z >= 1) & (z <= m) & (lam > 0))
    up = _series(z[todo], m[todo], lam[todo], 1)
    down = _series(z[todo], np.zeros(len(todo)), lam[todo], -1) - 1
    with np.errstate(over="ignore", invalid="ignore"):
        out[todo] = np.where(np.isinf(up), 1.0, 1 / (1 + down / up))
    # where the bound lies far below the rate, P(X <= m) may be 0 in double precision
    low = (lam[todo] > 700) & (lam[todo] > m[todo]) & np.isfinite(up + down)
    out[todo[low][_log_term(z[todo[low]], lam[todo[low]]) + np.log((up + down)[low]) < UNDERFLOW]] = 1.0
    below = np.flatnonzero(ok & (lam > 700) & (lam > m) & (z > m))
    # z = m + 1 and beyond: the same guard comes first
    out[below[_log_term(m[below], lam[below]) + np.log(m[below] + 1) < UNDERFLOW]] = 1.0
    return out


def _log_term(z: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """The log of the Poisson probability of each z."""
    return z * np.log(lam) - lam - np.fromiter(map(math.lgamma, z + 1), float, len(z))


def _series(z: np.ndarray, end: np.ndarray, lam: np.ndarray, step: int) -> np.ndarray:
    """Sum of Poisson terms from z to ``end``, upward or downward, relative to the term at z."""
    total, term, at = np.ones(len(z)), np.ones(len(z)), z.copy()
    active = np.flatnonzero(at != end)
    with np.errstate(over="ignore"):
        while len(active):
            i = at[active]
            ratio = lam[active] / (i + 1) if step > 0 else i / lam[active]
            at[active] = i + step
            term[active] *= ratio
            total[active] += term[active]
            falling = at[active] > lam[active] if step > 0 else at[active] < lam[active]
            done = (at[active] == end[active]) | (falling & (term[active] < 1e-17 * total[active])) | np.isinf(total[active])
            active = active[~done]
    return total


def p_value(z: Column, m: Column, lam: Column) -> Column:
    """The truncated tail as a column, null where lam is null or negative."""

    @F.pandas_udf("double")
    def tail(z: pd.Series, m: pd.Series, lam: pd.Series) -> pd.Series:
        found = truncated_tail(z.to_numpy(float), m.to_numpy(float), lam.to_numpy(float))
        return pd.Series(pd.arrays.FloatingArray(np.nan_to_num(found), np.isnan(found)))

    return tail(z.cast("double"), m.cast("double"), lam.cast("double"))


def z_score(x: Column, lam: Column) -> Column:
    """(x - lam) / sqrt(lam), null unless lam is positive."""
    return F.when(lam > 0, (x - lam) / F.sqrt(lam))


def anscombe_ratio(x: Column, lam: Column) -> Column:
    """Half the log2 ratio of x and lam, both with 3/8 added."""
    return F.when(lam >= 0, (F.log2(x + F.lit(0.375)) - F.log2(lam + F.lit(0.375))) / 2)


def relative_change(x: Column, lam: Column) -> Column:
    """log2 x - log2 lam, null unless both are positive."""
    return F.when((x > 0) & (lam > 0), F.log2(x) - F.log2(lam))
