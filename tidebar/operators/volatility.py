"""Rolling historical volatility and the conditional-volatility forecast chain.

The models are refitted for every row on the `window` returns before it.  Rows are independent, so
they are spread over fixed blocks of the series; a block carries `window` halo rows, and the fits of
all its rows run together as array arithmetic inside one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tidebar.operators.series import BLK, BLOCK, KEYS, halo, in_blocks, log_return_in, spread

MAX_VOL, MIN_VOL = 5.0, 1e-6
FIT_BLOCK = 256


def hist_vol(df: DataFrame, window: int = 500, col: str = "close", out: str = "hist_vol",
             keys: Sequence[str] = KEYS) -> DataFrame:
    """Sample deviation of the previous `window` log returns (in percent), in one shuffle."""
    return _with_rolling(df, window, col, "_lr", out, keys).drop("_lr")


def _with_rolling(df, window, col, ret, out, keys):
    def build(d, w):
        d = d.withColumn(ret, log_return_in(col, w))
        frame = w(-window, -1)
        return d.withColumn(out, F.when(F.count(ret).over(frame) == window, F.stddev_samp(ret).over(frame)))
    return in_blocks(df, build, keys=keys, back=window + 1, size=max(BLOCK, 4 * window))


def valid(v):
    """Finite and inside the sanity range."""
    return F.when(v.isNotNull() & ~F.isnan(v) & (v <= MAX_VOL) & (v >= MIN_VOL), v)


def choose(first, second, fallback):
    """First sane forecast; the last fallback is taken as it is."""
    return F.coalesce(valid(first), valid(second), fallback)


# Where every fit starts: the best point of these grids.  The intercept is set by variance targeting.
GARCH_GRID = [(a, b) for a in (0.02, 0.05, 0.08, 0.12, 0.2) for b in (0.6, 0.75, 0.85, 0.9, 0.94, 0.97)
              if a + b < 0.999]
EGARCH_GRID = [(a, g, b, 8.0) for a in (0.05, 0.15, 0.3) for g in (-0.1, 0.0, 0.1)
               for b in (0.6, 0.85, 0.95)]
# First steps of the search around it, halved in every round, and the limits of each parameter.
GARCH_STEP, GARCH_LIMITS = (0.03, 0.06), ((0.0, 0.5), (0.0, 0.999))
EGARCH_STEP, EGARCH_LIMITS = (0.08, 0.06, 0.08, 4.0), ((0.0, 0.8), (-0.5, 0.5), (-0.2, 0.999), (2.5, 60.0))
ROUNDS = 3
MEAN_ABS_Z = 0.7978845608028654
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _garch_paths(x: np.ndarray, var: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(negative log likelihood, next variance) of each row of x under each of its parameter points (rows x points x 2)."""
    a, b = p[..., 0], p[..., 1]
    w = (1 - a - b) * var[:, None]
    h = np.broadcast_to(var[:, None], a.shape).copy()
    ll = np.zeros(a.shape)
    for t in range(x.shape[1]):
        e2 = (x[:, t] ** 2)[:, None]
        ll += np.log(h) + e2 / h
        h = w + a * e2 + b * h
    bad = (a + b >= 0.9999) | ~np.isfinite(ll)
    return np.where(bad, np.inf, ll), h


def _egarch_paths(x: np.ndarray, var: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for log variances with asymmetry and a standardised t distribution (rows x points x 4)."""
    a, g, b, dof = (p[..., i] for i in range(4))
    logv = np.log(var)[:, None]
    w = (1 - b) * logv
    lh = np.broadcast_to(logv, a.shape).copy()
    ll = np.zeros(a.shape)
    for t in range(x.shape[1]):
        z = x[:, t][:, None] * np.exp(-0.5 * lh)
        ll += 0.5 * lh + 0.5 * (dof + 1) * np.log1p(z * z / (dof - 2))
        lh = w + a * (np.abs(z) - MEAN_ABS_Z) + g * z + b * lh
    ll -= x.shape[1] * (_lgamma((dof + 1) / 2) - _lgamma(dof / 2) - 0.5 * np.log(np.pi * (dof - 2)))
    return np.where(np.isfinite(ll), ll, np.inf), np.exp(lh)


def _search(paths, grid, step, limits, x: np.ndarray, var: np.ndarray, rounds: int = ROUNDS):
    """(points, negative log likelihood, next variance) of the best point found for every row of x at once.

    From the best grid point, each round tries a step up and down in every parameter, moves to the best of them and the
    centre, and halves the steps; the centre is always among the choices, so no round can lose likelihood.
    """
    low, high = np.array(limits).T
    points = np.broadcast_to(np.array(grid), (len(x), len(grid), len(limits)))
    size = np.array(step)
    best = None
    for k in range(rounds + 1):
        ll, h = paths(x, var, points)
        pick = ll.argmin(axis=1)[:, None]
        found = (np.take_along_axis(points, pick[:, :, None], axis=1)[:, 0], np.take_along_axis(ll, pick, axis=1)[:, 0],
                 np.take_along_axis(h, pick, axis=1)[:, 0])
        if best is None:
            best = found
        else:
            better = found[1] < best[1]
            best = tuple(np.where(better[:, None] if f.ndim == 2 else better, f, o) for f, o in zip(found, best))
        star = np.vstack([np.diag(size), -np.diag(size)])
        points = np.clip(best[0][:, None, :] + star[None], low, high)
        size = size / 2
    return best


def fit_garch(x: np.ndarray, var: np.ndarray, rounds: int = ROUNDS):
    return _search(_garch_paths, GARCH_GRID, GARCH_STEP, GARCH_LIMITS, x, var, rounds)


def fit_egarch(x: np.ndarray, var: np.ndarray, rounds: int = ROUNDS):
    return _search(_egarch_paths, EGARCH_GRID, EGARCH_STEP, EGARCH_LIMITS, x, var, rounds)


def _sane(v: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.isfinite(v) & (v <= MAX_VOL) & (v >= MIN_VOL)


def forecast_rows(ret: np.ndarray, window: int, both: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(EGARCH, GARCH) deviation forecasts for positions window..len(ret)-1.

    The second model is fitted only for rows whose first forecast is not sane, unless `both`.
    """
    view = np.lib.stride_tricks.sliding_window_view(ret, window)[:-1]
    eg, ga = np.full(len(view), np.nan), np.full(len(view), np.nan)
    for lo in range(0, len(view), 128):
        part = view[lo:lo + 128]
        x = part - part.mean(axis=1, keepdims=True)
        var = x.var(axis=1)
        ok = np.flatnonzero(var > 0)
        with np.errstate(all="ignore"):
            eg[lo + ok] = np.sqrt(fit_egarch(x[ok], var[ok])[2])
            todo = ok if both else ok[~_sane(eg[lo + ok])]
            if len(todo):
                ga[lo + todo] = np.sqrt(fit_garch(x[todo], var[todo])[2])
    return eg, ga


def newest_fits(df: DataFrame, window: int = 500, col: str = "close", keys: Sequence[str] = KEYS) -> DataFrame:
    """Per series the fits on its newest `window` returns: chosen points, log likelihoods and next deviations, beside
    those of the grid's best point alone."""
    keys = list(keys)
    recent = in_blocks(df, lambda d, w: d.withColumn("_lr", log_return_in(col, w)), keys=keys, back=1)
    rows = recent.filter((F.col("n_bars") >= window) & (F.col("bar_idx") >= F.col("n_bars") - window))
    arrays = rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("bar_idx", "_lr"))),
                                                 lambda s: s["_lr"]).alias("_x"))          # `window` numbers a series
    names = [f"{m}_{v}" for m in ("egarch", "garch") for v in ("grid_loss", "grid_vol", "loss", "vol")]
    fields = [f for f in arrays.schema if f.name in keys]
    schema = T.StructType(fields + [T.StructField(n, T.DoubleType()) for n in names] + [
        T.StructField(f"{m}_point", T.ArrayType(T.DoubleType())) for m in ("egarch", "garch")])

    def fit(batches):
        for pdf in batches:
            out = pdf[keys].copy()
            x = np.vstack(pdf["_x"].to_numpy()) if len(pdf) else np.zeros((0, window))
            x = x - x.mean(axis=1, keepdims=True)
            var = x.var(axis=1)
            for name, search in (("egarch", fit_egarch), ("garch", fit_garch)):
                with np.errstate(all="ignore"):
                    _, out[f"{name}_grid_loss"], h0 = search(x, var, 0)
                    point, out[f"{name}_loss"], h1 = search(x, var)
                out[f"{name}_grid_vol"], out[f"{name}_vol"], out[f"{name}_point"] = np.sqrt(h0), np.sqrt(h1), list(point)
            yield out[schema.names]
    return arrays.mapInPandas(fit, schema)


def conditional_vol(df: DataFrame, window: int = 500, col: str = "close", out: str = "EGARCH_Vol",
                    keys: Sequence[str] = KEYS, keep_parts: bool = False) -> DataFrame:
    """EGARCH -> GARCH -> historical volatility per row; rows before the first window are dropped."""
    keys = list(keys)
    base = _with_rolling(df, window, col, "_lr", "_hv", keys)
    need = base.select(*keys, "bar_idx", "n_bars", "_lr", "_hv")
    schema = T.StructType([f for f in need.schema if f.name in (*keys, "bar_idx")] + [
        T.StructField("_eg", T.DoubleType()), T.StructField("_ga", T.DoubleType())])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx")
        if len(pdf) <= window:
            return pdf.iloc[:0][[*keys, "bar_idx"]].assign(_eg=0.0, _ga=0.0)
        eg, ga = forecast_rows(pdf["_lr"].to_numpy(float), window, keep_parts)
        res = pdf.iloc[window:][[*keys, "bar_idx", BLK]].assign(_eg=eg, _ga=ga)
        return res[res[BLK] == res["bar_idx"] // FIT_BLOCK].drop(columns=BLK)

    blocks = spread(halo(need, back=window, size=FIT_BLOCK), *keys, BLK)
    fits = blocks.groupBy(*keys, BLK).applyInPandas(fit, schema)
    res = (base.join(fits, [*keys, "bar_idx"])
           .withColumn(out, choose(F.col("_eg"), F.col("_ga"), F.col("_hv"))))
    if keep_parts:
        res = res.withColumns({"egarch": F.col("_eg"), "garch": F.col("_ga"), "hist": F.col("_hv")})
    return res.drop("_eg", "_ga", "_lr", "_hv")
