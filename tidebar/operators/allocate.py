"""Capital allocation over strategies: covariance windows, HRP, shrinkage, tournament, equity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidebar.functions.expr import dbl
from tidebar.operators.metrics import ANNUAL
from tidebar.operators.series import dense_index, fill, day_number
from tidebar.session import cut

LOOKBACK, STEP = 100, 20
SHRINK = 0.85
SHARPE_FLOOR, SHARPE_FLAT = 0.05, 0.1


def _spine(source: DataFrame, key: str, first: int, last: int, number: str) -> DataFrame:
    """Every strategy at every number from first to last, the result's own size: each name's row is exploded, nothing
    is paired by a join.  `n_all` is the number of strategies."""
    names = cut(source.select(key).distinct())
    numbers = F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long")) if last >= first else F.array().cast("array<long>")
    return names.select(key, F.explode(numbers).alias(number), F.lit(names.count()).alias("n_all"))


def align(curves: DataFrame, key: str = "strategy", value: str = "equity") -> DataFrame:
    """Equity curves on the union of all dates, carried forward, 1.0 before the first value."""
    days = curves.select("date").distinct().withColumn("_all", F.lit(0))
    days = cut(dense_index(days, ["_all"], "date", F.year("date"), "_i", "_n").select("date", "_i"))
    grid = _spine(curves, key, 0, days.count() - 1, "_i").join(days, "_i").select("date", key)
    d = grid.join(curves, ["date", key], "left").withColumn("_pos", day_number("date"))
    return (fill(d, [value], keys=[key], pos="_pos", backfill=False)
            .withColumn(value, F.coalesce(value, dbl(1.0))).drop("_pos"))


def numbered_returns(returns: DataFrame, key: str = "strategy") -> DataFrame:
    """Add the common day number `i` (0-based) and `n_days` to (date, strategy, ret)."""
    days = returns.select("date").distinct().withColumn("_all", F.lit(0))
    days = dense_index(days, ["_all"], "date", F.year("date"), "i", "n_days").drop("_all")
    return returns.join(days, "date")


def windows(returns: DataFrame, lookback: int = LOOKBACK, step: int = STEP) -> DataFrame:
    """Copy each row into the rebalance windows that look back at it: [w*step - lookback, w*step)."""
    first = F.greatest(F.floor(F.col("i") / step) + 1, F.lit(lookback // step))
    last = F.least(F.floor((F.col("i") + lookback) / step), F.floor((F.col("n_days") - 1) / step))
    return (returns.filter(last >= first)
            .withColumn("window_id", F.explode(F.sequence(first, last))))


def window_arrays(win: DataFrame, key: str = "strategy", ret: str = "ret",
                  groups: Sequence[str] = ("window_id",)) -> DataFrame:
    """One array of `lookback` returns per (window, strategy), with mean and sample deviation.

    Strategies that do not move inside the window are dropped.
    """
    return (win.groupBy(*groups, key)
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("i", ret))), lambda s: s[ret]).alias("r"),
                 F.avg(ret).alias("mean_ret"), F.stddev_samp(ret).alias("std_ret"))
            .filter("std_ret > 0"))


def _cov_corr(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sample covariance and correlation of the rows of x."""
    cov = np.atleast_2d(np.cov(x))
    sd = np.sqrt(np.diag(cov))
    corr = cov / np.outer(sd, sd)
    np.fill_diagonal(corr, 1.0)
    return cov, corr


def _per_window(arrays: DataFrame, key: str, groups: Sequence[str], out: str, kernel) -> DataFrame:
    """`kernel(names, returns)` once per window over its strategies in order: windows are the parallel axis, and a
    strategy's returns travel once."""
    groups = list(groups)
    need = arrays.select(*groups, key, "r")
    types = dict(need.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in groups) + ", " + out.replace("KEY", types[key])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        rows = kernel(pdf[key].to_numpy(object), np.vstack(pdf["r"].to_numpy()))
        for c in reversed(groups):
            rows.insert(0, c, pdf[c].iloc[0])
        return rows
    return need.groupBy(*groups).applyInPandas(run, schema)


def covariance(arrays: DataFrame, key: str = "strategy", groups: Sequence[str] = ("window_id",)) -> DataFrame:
    """Covariance, correlation and distance per (window, a <= b): one matrix product a window, a row per matrix cell."""
    def cells(names, x):
        cov, corr = _cov_corr(x)
        i, j = np.triu_indices(len(names))
        return pd.DataFrame({"a": names[i], "b": names[j], "cov": cov[i, j], "corr": corr[i, j]})
    out = _per_window(arrays, key, groups, "a KEY, b KEY, cov double, corr double", cells)
    return out.withColumn("dist", distance(F.col("corr")))


def distance(corr):
    return F.sqrt(F.greatest((1 - corr) / 2, dbl(0.0)))


def inverse_variance(arrays: DataFrame, key: str = "strategy", groups: Sequence[str] = ("window_id",)) -> DataFrame:
    """Weights in inverse proportion to the variances, which `window_arrays` has: no matrix at all."""
    w = Window.partitionBy(*groups)
    inverse = 1 / (F.col("std_ret") * F.col("std_ret"))
    return arrays.select(*groups, F.col(key).alias("strategy"), (inverse / F.sum(inverse).over(w)).alias("weight"))


# --- hierarchical risk parity: a kernel over one small matrix -------------------------------------

def leaf_order(dist: np.ndarray) -> list[int]:
    """Leaves of the single-linkage tree from left to right.

    Clusters are numbered in the order they form; of equal gaps the lowest numbers merge first, the lower one on the left.
    A merged cluster keeps one row of the matrix: its gap to any other is the smaller of two, so a row's smallest gap
    changes for that row alone, and all merges together take N x N steps.
    """
    n = len(dist)
    gap = np.array(dist, float)
    np.fill_diagonal(gap, np.inf)
    least = gap.min(axis=1) if n > 1 else np.full(n, np.inf)
    number = np.arange(n, dtype=float)                      # of the cluster in each row; merged rows have none
    leaves = [[i] for i in range(n)]
    for new in range(n, 2 * n - 1):
        low = least.min()
        i = int(np.where(least == low, number, np.inf).argmin())
        j = int(np.where(gap[i] == low, number, np.inf).argmin())
        leaves[i] = leaves[i] + leaves[j]
        row = np.minimum(gap[i], gap[j])
        row[[i, j]] = np.inf
        gap[i], gap[:, i] = row, row
        gap[j], gap[:, j] = np.inf, np.inf
        least[i], least[j] = row.min(), np.inf
        number[i], number[j] = new, np.inf
    return leaves[int(np.argmin(number))] if n else []


def hrp_weights(cov: np.ndarray, corr: np.ndarray) -> np.ndarray:
    order = leaf_order(np.sqrt(np.clip((1 - corr) / 2, 0, None)))
    weight = np.ones(len(cov))

    def risk(items):
        sub = cov[np.ix_(items, items)]
        ivp = 1 / np.diag(sub)
        ivp /= ivp.sum()
        return ivp @ sub @ ivp

    todo = [order]
    while todo:
        part = todo.pop()
        if len(part) < 2:
            continue
        left, right = part[:len(part) // 2], part[len(part) // 2:]
        share = 1 - risk(left) / (risk(left) + risk(right))
        weight[left] *= share
        weight[right] *= 1 - share
        todo += [left, right]
    return weight


def hrp(arrays: DataFrame, groups: Sequence[str] = ("window_id",), key: str = "strategy") -> DataFrame:
    """HRP weight per (window, strategy): a kernel call sees one N x N matrix."""
    return _per_window(arrays, key, groups, f"`{key}` KEY, hrp double",
                       lambda names, x: pd.DataFrame({key: names, "hrp": hrp_weights(*_cov_corr(x))}))


def performance_weights(arrays: DataFrame, groups: Sequence[str] = ("window_id",)) -> DataFrame:
    """Weights in proportion to the floored Sharpe of the window."""
    w = Window.partitionBy(*groups)
    s = F.greatest(dbl(SHARPE_FLOOR), F.when(F.col("std_ret") > 0, F.col("mean_ret") / F.col("std_ret")
                                              * ANNUAL).otherwise(dbl(SHARPE_FLAT)))
    return (arrays.withColumn("_s", s)
            .withColumn("perf", F.col("_s") / F.sum("_s").over(w))
            .withColumn("n_valid", F.count(F.lit(1)).over(w)).drop("_s"))


def shrink(weights: DataFrame, base: str, groups: Sequence[str] = ("window_id",),
           lam: float = SHRINK) -> DataFrame:
    """(1-lam) * base + lam * perf, clamped to [0.15/N, min(0.55, 2.5/N)] and renormalised."""
    n = F.col("n_valid")
    raw = (1 - lam) * F.col(base) + lam * F.col("perf")
    clamped = F.greatest(0.15 / n, F.least(F.least(dbl(0.55), 2.5 / n), raw))
    w = Window.partitionBy(*groups)
    return (weights.withColumn("_w", clamped)
            .withColumn("weight", F.col("_w") / F.sum("_w").over(w)).drop("_w"))


def tournament(win: DataFrame, weights: DataFrame, key: str = "strategy",
               groups: Sequence[str] = ("window_id",)) -> DataFrame:
    """Per window: does the weighted portfolio's Sharpe reach that of equal weights?"""
    groups = list(groups)
    daily = (win.join(weights.select(*groups, key, "weight"), [*groups, key])
             .groupBy(*groups, "i").agg(F.sum(F.col("weight") * F.col("ret")).alias("_h"),
                                        F.avg("ret").alias("_e")))
    sr = lambda c: F.when(F.stddev_samp(c) > 0, F.avg(c) / F.stddev_samp(c)).otherwise(dbl(0.0))
    return (daily.groupBy(*groups).agg(sr("_h").alias("sharpe_weighted"), sr("_e").alias("sharpe_equal"))
            .withColumn("use_weighted", F.col("sharpe_weighted") >= F.col("sharpe_equal")))


def rebalance(days: DataFrame, key: str = "strategy", base: str = "hrp") -> tuple[DataFrame, DataFrame]:
    """(weights per window and strategy, tournament per window); `days` from `numbered_returns`.

    `base` is `hrp`, or `ivp` for inverse variance.  Windows with fewer than two moving strategies
    have no weights; the ones before stay in force.  The window table and the weights are read
    several times, so each is written once.
    """
    win = windows(days)
    arrays = cut(performance_weights(window_arrays(win, key)).filter("n_valid > 1"))
    if base == "hrp":
        base_w = hrp(arrays, key=key)
    else:
        w = Window.partitionBy("window_id")
        inverse = 1 / (F.col("std_ret") * F.col("std_ret"))
        base_w = arrays.select("window_id", key, (inverse / F.sum(inverse).over(w)).alias("ivp"))
    weights = cut(shrink(arrays.drop("r").join(base_w, ["window_id", key]), base))
    return weights, tournament(win, weights, key)


def hold_weights(days: DataFrame, weights: DataFrame, contest: DataFrame,
                 key: str = "strategy") -> DataFrame:
    """Weights in force on every day from the first rebalance on: `w_main` and `w_contest`.

    A window without weights keeps those of the one before; before any, all are 1/N.
    """
    d = days.filter(F.col("i") >= LOOKBACK).withColumn("window_id", F.floor(F.col("i") / STEP))
    ends = d.agg(F.min("window_id").alias("a"), F.max("window_id").alias("z")).first()      # two numbers
    spine = _spine(days, key, *((ends["a"], ends["z"]) if ends["a"] is not None else (0, -1)), "window_id")
    on = ["window_id", key]
    have = contest.select("window_id", "use_weighted")
    w = (spine.join(have, "window_id", "left").join(weights.select(*on, "weight"), on, "left")
         .withColumn("w_main", F.when(F.col("use_weighted").isNotNull(), F.coalesce("weight", dbl(0.0))))
         .withColumn("w_contest", F.when(F.col("use_weighted"), F.col("w_main"))
                     .when(~F.col("use_weighted"), 1 / F.col("n_all"))))
    w = fill(w, ["w_main", "w_contest"], keys=[key], pos="window_id", backfill=False)
    equal = 1 / F.col("n_all")
    w = cut(w.withColumns({"w_main": F.coalesce("w_main", equal), "w_contest": F.coalesce("w_contest", equal)}))
    return d.join(w.select(*on, "n_all", "w_main", "w_contest"), on)


def portfolio_returns(held: DataFrame, signal: str | None = None) -> DataFrame:
    """Daily portfolio returns in long form: weighted, tournament, equal, equal with a trend filter."""
    r = F.col("ret")
    parts = [("HRP", F.sum(F.col("w_main") * r)), ("TORNEO", F.sum(F.col("w_contest") * r)),
             ("EQUAL", F.sum(r / F.col("n_all")))]
    if signal:
        parts.append(("EQUAL_SMA", F.sum(F.when(F.col(signal), r).otherwise(dbl(0.0)) / F.col("n_all"))))
    daily = held.groupBy("date", "i").agg(*[e.alias(n) for n, e in parts])
    pairs = ", ".join(f"'{n}', `{n}`" for n, _ in parts)
    return daily.select("date", "i", F.expr(f"stack({len(parts)}, {pairs}) as (portfolio, ret)"))


def active_weights(active: DataFrame, weights: DataFrame) -> DataFrame:
    """Weights of the active symbols, renormalised; equal where none has any weight."""
    w = Window.partitionBy()
    d = active.join(weights, "symbol", "left").withColumn("weight", F.coalesce("weight", dbl(0.0)))
    total = F.sum("weight").over(w)
    return d.withColumn("norm_weight", F.when(total > 0, F.col("weight") / total)
                        .otherwise(1 / F.count(F.lit(1)).over(w)))
