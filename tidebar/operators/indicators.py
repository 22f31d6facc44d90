"""Exponential averages and the MACD / RSI / ATR block of indicators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebar.functions.expr import dbl
from tidebar.operators.series import BLK, KEYS, in_blocks

WEIGHT_EPS = 1e-17   # weights below this are lost in double precision anyway
SCALE_NATS = 600.0   # e^600 keeps scaled sums far inside the double range
WILDER = 1 / 14


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1)


def reach(alpha: float) -> int:
    """Rows after which the weight of an old value is below `WEIGHT_EPS`."""
    return math.ceil(math.log(WEIGHT_EPS) / math.log(1 - alpha))


def block_size(alphas: Sequence[float], back: int) -> int:
    fastest = max(alphas)
    return max(64, int(SCALE_NATS / -math.log(1 - fastest)) - back)


def ema_in(x: Column, alpha: float, w, back: int, size: int) -> Column:
    """EMA (adjust=False) inside a haloed block as one running sum.

    y_t = b^k * sum_j c_j b^-j with b = 1-alpha, c = alpha*x except that the very first value of a
    series seeds the average.  The block is short enough for b^-j to stay in range.
    """
    beta = dbl(1 - alpha)
    k = (F.col("bar_idx") - F.col(BLK) * size + back).cast("double")
    seeded = F.when(F.col("bar_idx") == 0, x).otherwise(dbl(alpha) * x)
    running = w(Window.unboundedPreceding, 0)
    return F.pow(beta, k) * F.sum(seeded * F.pow(beta, -k)).over(running)


def ema(df: DataFrame, alpha: float, col: str = "close", out: str = "ema",
        keys: Sequence[str] = KEYS) -> DataFrame:
    back = reach(alpha)
    size = block_size([alpha], back)
    return in_blocks(df, lambda d, w: d.withColumn(out, ema_in(F.col(col), alpha, w, back, size)),
                     keys=keys, back=back, size=size)


def _macd(d: DataFrame, w, back: int, size: int, col: str) -> DataFrame:
    d = d.withColumn("MACD", ema_in(F.col(col), span_alpha(12), w, back, size)
                     - ema_in(F.col(col), span_alpha(26), w, back, size))
    d = d.withColumn("MACD_Signal", ema_in(F.col("MACD"), span_alpha(9), w, back, size))
    return d.withColumn("MACD_Hist", F.col("MACD") - F.col("MACD_Signal"))


def _rsi(d: DataFrame, w, back: int, size: int, col: str) -> DataFrame:
    d = d.withColumn("_dx", F.col(col) - F.lag(col).over(w()))
    gain = F.when(F.col("_dx") > 0, F.col("_dx")).otherwise(dbl(0.0))
    loss = F.when(F.col("_dx") < 0, -F.col("_dx")).otherwise(dbl(0.0))
    d = d.withColumns({"_g": gain, "_q": loss})
    d = d.withColumns({"_ag": ema_in(F.col("_g"), WILDER, w, back, size),
                       "_al": ema_in(F.col("_q"), WILDER, w, back, size)})
    rs = F.col("_ag") / F.when(F.col("_al") == 0, dbl(1e-10)).otherwise(F.col("_al"))
    return d.withColumn("RSI", 100 - 100 / (1 + rs)).drop("_dx", "_g", "_q", "_ag", "_al")


def true_range(w, col: str = "close") -> Column:
    prev = F.lag(col).over(w())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev),
                      F.abs(F.col("low") - prev))


def _atr(d: DataFrame, w, back: int, size: int, col: str) -> DataFrame:
    d = d.withColumn("TR", true_range(w, col))
    return d.withColumn("ATR", ema_in(F.col("TR"), WILDER, w, back, size))


def _run(df: DataFrame, parts, col: str, keys: Sequence[str]) -> DataFrame:
    back = reach(span_alpha(26)) + reach(span_alpha(9))
    size = block_size([span_alpha(9)], back)

    def build(d, w):
        for part in parts:
            d = part(d, w, back, size, col)
        return d
    return in_blocks(df, build, keys=keys, back=back, size=size)


def macd(df, col="close", keys=KEYS):
    return _run(df, [_macd], col, keys)


def rsi(df, col="close", keys=KEYS):
    return _run(df, [_rsi], col, keys)


def atr(df, col="close", keys=KEYS):
    return _run(df, [_atr], col, keys)


def add_indicators(df: DataFrame, col: str = "close", keys: Sequence[str] = KEYS,
                   min_bars: int = 0) -> DataFrame:
    """MACD, RSI and ATR in one shuffle.  `min_bars` drops a warm-up prefix (0 keeps all rows)."""
    missing = [c for c in (col, "high", "low") if c not in df.columns]
    if missing:
        raise ValueError(f"columns needed for the indicators are missing: {missing}")
    out = _run(df, [_macd, _rsi, _atr], col, keys).drop("TR")
    out = out.na.drop(subset=["MACD_Hist", "RSI", "ATR"])
    return out.filter(F.col("bar_idx") >= min_bars) if min_bars else out
