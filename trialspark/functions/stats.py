"""Tails of the t and F distributions, as vectorised column functions over few rows (one for each test)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction (Lentz's method)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    total = d.copy()
    for m in range(1, 300):
        for term in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + term * d
            c = 1 + term / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            total = total * d * c
    out = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * total))
    return np.where(swap, 1 - out, out)


def f_tail(f: Column, k1: Column, k2: Column) -> Column:
    """P(F > f) with k1 and k2 degrees of freedom; null where f is."""

    @F.pandas_udf("double")
    def tail(f: pd.Series, k1: pd.Series, k2: pd.Series) -> pd.Series:
        return pd.Series(incomplete_beta(k2 / 2, k1 / 2, k2 / (k2 + k1 * f.clip(lower=0))))

    return F.when(f.isNotNull(), tail(f.cast("double"), k1.cast("double"), k2.cast("double")))


def t_tails(t: Column, k: Column) -> Column:
    """P(|T| > |t|) with k degrees of freedom; null where t is."""
    return f_tail(t * t, F.lit(1.0), k)


def stars(p: Column) -> Column:
    """**** to 1e-4, *** to 0.001, ** to 0.01, * to 0.05, else n.s."""
    return F.when(p <= 1e-4, "****").when(p <= 1e-3, "***").when(p <= 1e-2, "**").when(p <= 0.05, "*").otherwise("n.s.")


def stars3(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def tier(accuracy: Column) -> Column:
    """What an accuracy of two classes amounts to."""
    return F.when(accuracy > 0.75, "strong").when(accuracy > 0.65, "moderate").when(accuracy > 0.55, "weak").otherwise("at chance")


def above_chance(accuracy: Column, chance: Column) -> Column:
    return F.when(accuracy > chance + 0.1, "clear").when(accuracy > chance + 0.05, "some").otherwise("none")
