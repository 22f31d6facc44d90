"""Scalar column expressions that neither engine has built in."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def dbl(x: float) -> Column:
    return F.lit(float(x))


def clip(x: Column, lo: float | Column, hi: float | Column) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else dbl(v)
    return F.greatest(as_col(lo), F.least(as_col(hi), x))


def r6(x: Column | str, digits: int = 6) -> Column:
    """Round for output; adding 0.0 turns a negative zero into zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


# Abramowitz & Stegun 26.2.17, |error| < 7.5e-8.
CDF_P = 0.2316419
CDF_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
INV_SQRT_2PI = 0.3989422804014327


def norm_cdf(z: Column) -> Column:
    """Standard normal distribution function."""
    a = F.least(F.abs(z), dbl(38.0))
    t = 1 / (1 + CDF_P * a)
    poly = dbl(0.0)
    for b in reversed(CDF_B):
        poly = t * (dbl(b) + poly)
    tail = dbl(INV_SQRT_2PI) * F.exp(-a * a / 2) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


# Acklam's rational approximation of the normal quantile, relative error < 1.15e-9.
PPF_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
PPF_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00)
PPF_LOW = 0.02425


def _horner(coefs, x: Column) -> Column:
    acc = dbl(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + dbl(c)
    return acc


def norm_ppf(p: Column) -> Column:
    """Standard normal quantile as a column expression."""
    q = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    tail = _horner(PPF_C, q) / (_horner(PPF_D, q) * q + 1)
    u = p - 0.5
    r = u * u
    mid = _horner(PPF_A, r) * u / (_horner(PPF_B, r) * r + 1)
    return (F.when(p < PPF_LOW, tail).when(p > 1 - PPF_LOW, -tail).otherwise(mid))


def norm_ppf_value(p: float) -> float:
    """The same quantile for a plan constant."""
    def h(coefs, x):
        acc = coefs[0]
        for c in coefs[1:]:
            acc = acc * x + c
        return acc
    if p < PPF_LOW or p > 1 - PPF_LOW:
        q = math.sqrt(-2 * math.log(min(p, 1 - p)))
        v = h(PPF_C, q) / (h(PPF_D, q) * q + 1)
        return v if p < PPF_LOW else -v
    u = p - 0.5
    r = u * u
    return h(PPF_A, r) * u / (h(PPF_B, r) * r + 1)


def dot(weights: Column, values: Column) -> Column:
    return F.aggregate(F.zip_with(weights, values, lambda a, b: a * b), dbl(0.0), lambda s, x: s + x)
