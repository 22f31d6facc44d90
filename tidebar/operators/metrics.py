"""Risk and return metrics per key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebar.functions.expr import dbl, norm_cdf, norm_ppf_value
from tidebar.operators.series import path_summary

ANNUAL = math.sqrt(252)
EULER = 0.5772156649
TIE = 1e-12


def sharpe(mean: Column, std: Column, factor: float = ANNUAL) -> Column:
    return F.when(std > 0, mean / std * factor).otherwise(dbl(0.0))


def cagr(total_ret: Column, days: Column) -> Column:
    """Annualised return over calendar days; -1 where all is lost, 0 without a time span."""
    years = days / 365.25
    return (F.when(days <= 0, dbl(0.0)).when(total_ret <= -1, dbl(-1.0))
            .otherwise(F.pow(1 + total_ret, 1 / years) - 1))


def ratio(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) > 0, a / F.abs(b)).otherwise(dbl(0.0))


def group_quantile(df: DataFrame, keys: Sequence[str], col: str, q: float, out: str,
                   width: float = 1e-3) -> DataFrame:
    """Exact linearly interpolated quantile per key without sorting a key in one task.

    Values are counted per bucket of `width`; only the one or two buckets that hold the wanted
    ranks are sorted.
    """
    keys = list(keys)
    base = df.filter(F.col(col).isNotNull()).select(*keys, F.col(col).alias("_x"))
    base = base.withColumn("_b", F.floor(F.col("_x") / width))
    by_bucket = Window.partitionBy(*keys).orderBy("_b")
    counts = (base.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_hi", F.sum("_n").over(by_bucket))
              .withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
              .withColumn("_lo", F.col("_hi") - F.col("_n"))
              .withColumn("_pos", (F.col("_total") - 1) * dbl(q)))
    lo_rank = F.floor(F.col("_pos"))
    hi_rank = F.ceil(F.col("_pos"))
    wanted = counts.filter(((lo_rank >= F.col("_lo")) & (lo_rank < F.col("_hi")))
                           | ((hi_rank >= F.col("_lo")) & (hi_rank < F.col("_hi"))))
    ranked = (base.join(wanted.select(*keys, "_b", "_lo", "_pos"), [*keys, "_b"])
              .withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_x"))
                          - 1 + F.col("_lo"))
              .filter((F.col("_r") == lo_rank) | (F.col("_r") == hi_rank)))
    frac = F.max("_pos") - F.floor(F.max("_pos"))
    return ranked.groupBy(*keys).agg(
        (F.min("_x") + (F.max("_x") - F.min("_x")) * frac).alias(out))


def moments(df: DataFrame, keys: Sequence[str], ret: str = "ret") -> DataFrame:
    """Count, mean, population deviation, skew and excess kurtosis."""
    return df.groupBy(*keys).agg(
        F.count(ret).alias("n"), F.avg(ret).alias("mean_ret"), F.stddev_pop(ret).alias("std_ret"),
        F.coalesce(F.skewness(ret), dbl(0.0)).alias("skew"),
        F.coalesce(F.kurtosis(ret), dbl(0.0)).alias("kurt"))


def tail_risk(df: DataFrame, keys: Sequence[str], ret: str = "ret", q: float = 0.05) -> DataFrame:
    """VaR (interpolated quantile) and CVaR (mean of the returns at or below it).

    A return that differs from VaR in the last bits only counts as equal, so that rounding does not
    decide ties.
    """
    keys = list(keys)
    var = group_quantile(df, keys, ret, q, "var_95")
    return (df.join(var, keys).groupBy(*keys)
            .agg(F.first("var_95").alias("var_95"),
                 F.coalesce(F.avg(F.when(F.col(ret) <= F.col("var_95") + TIE, F.col(ret))), dbl(0.0))
                 .alias("cvar_95")))


def psr(n: Column, sr: Column, skew: Column, kurt: Column) -> Column:
    """Probabilistic Sharpe ratio of a per-trade Sharpe against zero."""
    var = (1 + 0.5 * sr * sr - skew * sr + kurt / 4 * (sr * sr)) / (n - 1)
    return F.when(n < 2, dbl(0.0)).otherwise(norm_cdf(sr / F.sqrt(F.greatest(dbl(1e-9), var))))


def expected_max_sharpe(n_trials: int, spread: float = 0.5) -> float:
    z = ((1 - EULER) * norm_ppf_value(1 - 1 / n_trials)
         + EULER * norm_ppf_value(1 - math.exp(-1) / n_trials))
    return spread * z


def dsr(n: Column, sr: Column, skew: Column, kurt: Column, n_trials: int) -> Column:
    """Deflated Sharpe ratio of an annualised Sharpe against the best of `n_trials`."""
    var = (1 - skew * sr + (kurt - 1) / 4 * (sr * sr)) / (n - 1)
    z = (sr - dbl(expected_max_sharpe(n_trials))) / F.sqrt(var)
    return F.when((n < 5) | (sr == 0) | (var <= 0), dbl(0.0)).otherwise(norm_cdf(z))


def trade_metrics(trades: DataFrame, keys: Sequence[str], n_trials: int = 21,
                  pos: str = "exit_idx") -> DataFrame:
    """One row per strategy: Sharpe, VaR, CVaR, STARR, PSR, DSR, MDD, win rate, duration."""
    keys = list(keys)
    flags = trades.groupBy(*keys).agg(
        F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.avg("duration").alias("avg_duration"), F.max("is_dead").alias("is_dead"),
        F.max(pos).alias("last_exit"))
    m = (moments(trades, keys).join(tail_risk(trades, keys), keys)
         .join(path_summary(trades, "ret", keys=keys, pos=pos), keys).join(flags, keys))
    raw = F.when(F.col("std_ret") > 0, F.col("mean_ret") / F.col("std_ret")).otherwise(dbl(0.0))
    small = F.col("n") < 2
    m = m.withColumns({
        "sr_raw": raw, "sharpe": raw * ANNUAL,
        "starr": ratio(F.col("mean_ret"), F.col("cvar_95")),
        "mdd": F.when(small, dbl(0.0)).otherwise(F.col("mdd")),
        "skew": F.when(small, dbl(0.0)).otherwise(F.col("skew")),
        "kurt": F.when(small, dbl(0.0)).otherwise(F.col("kurt"))})
    return m.withColumns({
        "psr": psr(F.col("n"), F.col("sr_raw"), F.col("skew"), F.col("kurt")),
        "dsr": dsr(F.col("n"), F.col("sharpe"), F.col("skew"), F.col("kurt"), n_trials)})


def series_metrics(df: DataFrame, keys: Sequence[str], ret: str = "ret", time: str = "time",
                   pos: str = "bar_idx") -> DataFrame:
    """Metrics of a per-bar return series: total return, CAGR, Sharpe, VaR/CVaR, MDD, STARR."""
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.datediff(F.max(time), F.min(time)).alias("days"))
    m = (moments(df, keys, ret).join(tail_risk(df, keys, ret), keys)
         .join(path_summary(df, ret, keys=keys, pos=pos), keys).join(span, keys))
    m = m.withColumns({"sharpe": sharpe(F.col("mean_ret"), F.col("std_ret")),
                       "cagr": cagr(F.col("total_ret"), F.col("days"))})
    return m.withColumn("starr", ratio(F.col("cagr"), F.col("mdd")))
