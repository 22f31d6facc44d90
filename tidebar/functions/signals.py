"""Per-row trading rules: signal, barriers, sizing and risk budget."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from tidebar.functions.expr import clip, dbl


def side(prob: Column, threshold: Column, bilateral: Column) -> Column:
    """1 long, -1 short, 0 cash; an unscored bar (NULL) gives no signal."""
    return (F.when(prob > threshold, 1)
            .when(bilateral & (prob < 1 - threshold), -1).otherwise(0))


def take_profit(price: Column, vol: Column, k_up: Column, direction: Column) -> Column:
    return F.when(direction >= 0, price * (1 + k_up * (vol / 100))).otherwise(
        price * (1 - k_up * (vol / 100)))


def stop_loss(price: Column, vol: Column, k_down: Column, direction: Column) -> Column:
    return F.when(direction >= 0, price * (1 - k_down * (vol / 100))).otherwise(
        price * (1 + k_down * (vol / 100)))


def kelly(prob: Column, threshold: Column) -> Column:
    """Risk multiplier 0.5 / 1 / 2 by the distance of the score from its threshold."""
    delta = F.greatest(dbl(0.0), F.when(prob > 0.5, prob - threshold).otherwise((1 - threshold) - prob))
    return F.when(delta <= 0.05, dbl(0.5)).when(delta <= 0.15, dbl(1.0)).otherwise(dbl(2.0))


def position_size(balance: Column, price: Column, stop: Column, tick_size: Column,
                  tick_value: Column, step: float, risk_pct: Column) -> Column:
    """Lots so that the stop costs `balance * risk_pct`, floored to the volume step."""
    digits = abs(int(math.log10(step)))
    per_lot = F.abs(price - stop) / tick_size * tick_value
    lots = F.round(F.floor(balance * risk_pct / per_lot / step) * dbl(step), digits)
    return F.when((price == stop) | (per_lot <= 0), dbl(0.0)).otherwise(lots)


def capped_notional(risk: Column, price: Column, stop: Column, cap: float) -> tuple[Column, Column]:
    """(notional, was it capped)."""
    raw = F.when(price != stop, risk / (F.abs(price - stop) / price)).otherwise(dbl(0.0))
    return F.least(raw, dbl(cap)), raw > cap


def risk_budget(mdd: Column, base: float = 0.045, cap: float = 0.0675) -> Column:
    return clip(0.20 / F.greatest(dbl(0.05), F.abs(mdd)) * base, 0.01, cap)


def kill_switch(mdd: Column) -> Column:
    return F.least(dbl(-0.20), 1.2 * mdd)
