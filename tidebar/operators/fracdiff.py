"""Fixed-width fractional differencing, unit-root tests and the smallest stationary order.

Tests run for every (series, column, order) at once: blocks of a series are reduced to Gram sums of
the test regression, the sums are added up by a vector aggregate, and only the tiny normal equations
of each key are solved in Python.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F, types as T

from tidebar.functions.expr import dbl, dot
from tidebar.operators.series import BLK, KEYS, halo, in_blocks, spread

THRESHOLD = 1e-4
P_LIMIT = 0.05
MIN_OBS = 100
D_GRID = tuple(i / 39 for i in range(40))
TEST_BLOCK = 4096

# MacKinnon (1994) response surface of the constant-only tau distribution.
TAU_STAR, TAU_MIN, TAU_MAX = -1.61, -18.83, 2.74
SMALL_P = (2.1659, 1.4412, 3.8269e-2)
LARGE_P = (1.7339, 0.93202, -0.12745, -1.0368e-2)

# Columns that are levels, regimes or volumes, never differenced.
PROTECTED = ("time", "MACD", "MACD_Signal", "MACD_Hist", "RSI", "ATR", "EGARCH_Vol", "TPM", "EMBI",
             "VIX_close", "tick_volume", "real_volume", "spread")
PRICES = ("open", "high", "low", "close")


def weights(d: float, threshold: float = THRESHOLD) -> list[float]:
    """Differencing weights, newest first; stops at the first weight below the threshold."""
    w = [1.0]
    while True:
        k = len(w)
        nxt = -w[-1] * (d - k + 1) / k
        if abs(nxt) < threshold:
            return w
        w.append(nxt)


def frac_diff(df: DataFrame, d: float, col: str = "close", out: str | None = None,
              threshold: float = THRESHOLD, keys: Sequence[str] = KEYS) -> DataFrame:
    """One order for all series; the first `width` rows are NULL."""
    w_ = weights(d, threshold)
    width = len(w_) - 1
    oldest_first = F.array(*[dbl(v) for v in reversed(w_)])

    def build(b, w):
        window = F.collect_list(F.col(col)).over(w(-width, 0))
        return b.withColumn(out or f"{col}_FFD", F.when(
            F.col("bar_idx") >= width, dot(oldest_first, window)))
    return in_blocks(df, build, keys=keys, back=width, size=max(4096, 4 * width))


# --- unit-root test -----------------------------------------------------------------------------

def p_value(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    coefs = SMALL_P if tau <= TAU_STAR else LARGE_P
    z = sum(c * tau ** i for i, c in enumerate(coefs))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def max_lag(n: int) -> int:
    return min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25))


def _regression_rows(y: np.ndarray, p0: int, n_lags: int, lo: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows [1, y_{p-1}, dy_{p-1}..dy_{p-L}, dy_p] for y positions lo.. (p0 = position of y[0])."""
    dy = np.diff(y)
    at = np.arange(lo, len(y))
    rows = np.zeros((len(at), n_lags + 3))
    rows[:, 0] = 1
    rows[:, 1] = y[at - 1]
    for k in range(1, n_lags + 1):
        has = at - 1 - k >= 0
        rows[has, 1 + k] = dy[at[has] - 1 - k]
    rows[:, -1] = dy[at - 1]
    return at + p0, rows


def _partials(pdf: pd.DataFrame, keys, orders, tables) -> pd.DataFrame:
    pdf = pdf.sort_values("bar_idx")
    idx = pdf["bar_idx"].to_numpy()
    x = pdf["value"].to_numpy(float)
    n = int(pdf["n_bars"].iloc[0])
    block = int(pdf[BLK].iloc[0])
    first, last = block * TEST_BLOCK, (block + 1) * TEST_BLOCK
    out = []
    for d_no in orders:
        w = tables[d_no]
        width = len(w) - 1
        if n - width < 8 or len(x) <= width:
            continue
        lags = max_lag(n - width)
        y = np.convolve(x, w, "valid")               # y[i] belongs to bar idx[0] + width + i
        p0 = int(idx[0])                             # position of y[0] in the differenced series
        own = np.arange(len(y)) + p0 + width
        mine = (own >= first) & (own < last)
        if not mine.any():
            continue
        xs, ys = x[width:][mine], y[mine]
        out.append((d_no, 0, [float(len(xs)), xs.sum(), ys.sum(), xs @ xs, ys @ ys, xs @ ys]))
        lo = max(int(np.argmax(mine)), 1)
        hi = len(y) - int(np.argmax(mine[::-1]))
        if hi <= lo:
            continue
        p, rows = _regression_rows(y[:hi], p0, lags, lo)
        common = rows[p >= lags + 1]
        if len(common):
            out.append((d_no, lags + 1, (common.T @ common).ravel().tolist()))
        for pos, row in zip(p[p <= lags], rows[p <= lags]):
            out.append((d_no, int(pos), row.tolist()))
    res = pd.DataFrame(out, columns=["d_no", "cls", "part"])
    for k in keys:
        res[k] = pdf[k].iloc[0]
    return res[[*keys, "d_no", "cls", "part"]]


def _ols(g: np.ndarray, n_obs: int, lag: int):
    """(tau of the level, residual sum) of the regression on const, level and `lag` differences."""
    pick = list(range(2 + lag))
    a, b = g[np.ix_(pick, pick)], g[pick, -1]
    scale = np.sqrt(np.diag(a))
    inv = np.linalg.inv(a / np.outer(scale, scale)) / np.outer(scale, scale)
    beta = inv @ b
    ssr = max(g[-1, -1] - beta @ b, 1e-300)
    return beta[1] / math.sqrt(ssr / (n_obs - len(pick)) * inv[1, 1]), ssr


def _solve(pdf: pd.DataFrame, keys, out_keys) -> pd.DataFrame:
    parts = {int(c): np.array(p, float) for c, p in zip(pdf["cls"], pdf["part"])}
    n, sx, sy, sxx, syy, sxy = parts.pop(0)
    row = {k: pdf[k].iloc[0] for k in out_keys}
    row |= {"n_obs": int(n), "best_lag": None, "tau": None, "p_value": None, "corr": None}
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    if vx > 0 and vy > 0:
        row["corr"] = float((sxy - sx * sy / n) / math.sqrt(vx * vy))
    lags = max_lag(int(n))
    gram = parts.pop(lags + 1, None)
    try:
        if gram is None:
            raise np.linalg.LinAlgError
        size = lags + 3
        gram = gram.reshape(size, size)
        nobs = int(round(gram[0, 0]))
        aic = [nobs * math.log(_ols(gram, nobs, k)[1] / nobs) + 2 * (k + 2) for k in range(lags + 1)]
        best = int(np.argmin(aic))
        for pos, vec in parts.items():               # rows that only the shorter regression can use
            if pos >= best + 1:
                gram = gram + np.outer(vec, vec)
        tau, _ = _ols(gram, int(round(gram[0, 0])), best)
        row |= {"best_lag": best, "tau": float(tau), "p_value": p_value(tau)}
    except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):
        pass
    return pd.DataFrame([row])


def adf(long: DataFrame, orders: Sequence[float] = (0.0,), keys: Sequence[str] = ("symbol", "column"),
        threshold: float = THRESHOLD) -> DataFrame:
    """Augmented Dickey-Fuller test (constant, AIC lag choice) of each series at each order.

    `long`: keys, bar_idx (dense), n_bars, value.  Result: one row per (keys, order).
    """
    keys = list(keys)
    tables = [np.array(weights(d, threshold)) for d in orders]
    nos = range(len(orders))
    need = long.select(*keys, "bar_idx", "n_bars", "value")
    longest = need.agg(F.max("n_bars")).first()[0] or 0     # one number: the lag order follows the longest series
    back = max(len(w) for w in tables) + 2 + max(max_lag(int(longest)), 0)
    key_fields = [f for f in need.schema if f.name in keys]
    key_fields.sort(key=lambda f: keys.index(f.name))
    part_schema = T.StructType(key_fields + [
        T.StructField("d_no", T.IntegerType()), T.StructField("cls", T.IntegerType()),
        T.StructField("part", T.ArrayType(T.DoubleType()))])
    partials = (spread(halo(need, back=back, size=TEST_BLOCK), *keys, BLK).groupBy(*keys, BLK)
                .applyInPandas(lambda pdf: _partials(pdf, keys, nos, tables), part_schema))
    sums = (partials.groupBy(*keys, "d_no", "cls")
            .agg(Summarizer.sum(array_to_vector("part")).alias("part"))
            .withColumn("part", vector_to_array("part")))
    out_keys = [*keys, "d_no"]
    out_schema = T.StructType(key_fields + [
        T.StructField("d_no", T.IntegerType()), T.StructField("n_obs", T.LongType()),
        T.StructField("best_lag", T.IntegerType()), T.StructField("tau", T.DoubleType()),
        T.StructField("p_value", T.DoubleType()), T.StructField("corr", T.DoubleType())])
    solved = sums.groupBy(*out_keys).applyInPandas(
        lambda pdf: _solve(pdf, keys, out_keys)[[f.name for f in out_schema]], out_schema)
    grid = F.array(*[dbl(d) for d in orders])
    return solved.withColumn("d", F.get(grid, F.col("d_no")))


def min_stationary_d(long: DataFrame, keys: Sequence[str] = ("symbol", "column"),
                     train_share: float = 0.8, orders: Sequence[float] = D_GRID,
                     p_limit: float = P_LIMIT, threshold: float = THRESHOLD) -> DataFrame:
    """Smallest order whose differenced training part passes the test; (1, 0) where none does."""
    keys = list(keys)
    cut_at = F.floor(F.col("n_bars") * dbl(train_share))
    train = long.filter(F.col("bar_idx") < cut_at).withColumn("n_bars", cut_at)
    tests = adf(train, orders, keys, threshold)
    ok = (F.col("p_value") <= p_limit) & (F.col("n_obs") >= MIN_OBS)
    best = tests.groupBy(*keys).agg(F.min_by(F.struct("d_no", "d", "corr"), F.when(ok, F.col("d_no")))
                                    .alias("_b"))
    return best.select(*keys, F.coalesce("_b.d_no", F.lit(len(orders) - 1)).alias("d_no"),
                       F.coalesce("_b.d", dbl(1.0)).alias("d"),
                       F.coalesce("_b.corr", dbl(0.0)).alias("corr"))


def melt(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols)
    return df.select(*keys, "bar_idx", "n_bars",
                     F.expr(f"stack({len(cols)}, {pairs}) as (column, value)"))


def ffd_report(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS,
               p_limit: float = P_LIMIT) -> DataFrame:
    """Per (series, column): was it stationary already, and the order to use (0 = leave as is)."""
    cols = [c for c in cols if c not in PROTECTED]
    long = melt(df, cols, keys)
    full_keys = [*keys, "column"]
    level = adf(long, (0.0,), full_keys).select(*full_keys, F.col("p_value").alias("level_p"))
    chosen = min_stationary_d(long, full_keys)
    stationary = F.coalesce(F.col("level_p") < p_limit, F.lit(False))
    return level.join(chosen, full_keys).select(
        *full_keys, "level_p", stationary.alias("stationary"),
        F.when(stationary, F.lit(0)).otherwise(F.col("d_no")).alias("d_no"),
        F.when(stationary, dbl(0.0)).otherwise(F.col("d")).alias("d"),
        F.when(stationary, dbl(1.0)).otherwise(F.col("corr")).alias("corr"))


def apply_ffd(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS,
              report: DataFrame | None = None) -> DataFrame:
    """Add `<col>_FFD` for every tested column and drop the raw column unless it is a price.

    Series whose column is stationary already keep it unchanged (order 0), so the schema does not
    depend on the data.  Rows with any NULL are dropped.
    """
    keys = list(keys)
    cols = [c for c in cols if c not in PROTECTED]
    report = ffd_report(df, cols, keys) if report is None else report
    table = [weights(d) for d in D_GRID]
    widest = max(map(len, table)) - 1
    chosen = report.groupBy(*keys).pivot("column", cols).agg(F.first("d_no"))
    chosen = chosen.select(*keys, *[F.col(c).alias(f"_d_{c}") for c in cols])
    # one row per order (40): a fixed size, so it is broadcast; joined after the shuffle of the bars
    lookup = df.sparkSession.createDataFrame(
        [(i, [float(v) for v in reversed(w)]) for i, w in enumerate(table)], "no int, w array<double>")

    def build(b, w):
        for c in cols:
            small = lookup.select(F.col("no").alias(f"_d_{c}"), F.col("w").alias("_w"))
            window = F.collect_list(F.col(c)).over(w(-widest, 0))
            b = b.withColumn("_x", window).join(F.broadcast(small), f"_d_{c}")
            aligned = F.slice("_x", -F.least(F.size("_w"), F.size("_x")), F.size("_w"))
            b = b.withColumn(f"{c}_FFD", F.when(F.col("bar_idx") >= F.size("_w") - 1,
                                                dot(F.col("_w"), aligned))).drop("_w", "_x")
        return b

    out = in_blocks(df.join(chosen, keys), build, keys=keys, back=widest, size=4096)
    drop = [f"_d_{c}" for c in cols] + [c for c in cols if c not in PRICES]
    return out.drop(*drop).na.drop("any")
