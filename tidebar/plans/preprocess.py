"""Raw bars to the labelled feature table, for all symbols in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidebar.operators.barriers import label
from tidebar.operators.fracdiff import apply_ffd
from tidebar.operators.indicators import add_indicators
from tidebar.operators.series import with_bar_idx
from tidebar.operators.volatility import conditional_vol


def preprocess(bars: DataFrame, ffd_cols: Sequence[str] = ("open", "high", "low", "close"),
               window: int = 500, max_hold: int = 10, zero_cols: Sequence[str] = ()) -> DataFrame:
    """Indicators, conditional volatility, fractional differencing and triple-barrier labels.

    `zero_cols` are the columns that the all-zero report names; dropping them is an explicit
    projection, so the schema is known when the plan is built.
    """
    d = add_indicators(bars.drop(*zero_cols))
    d = with_bar_idx(conditional_vol(d, window))
    d = with_bar_idx(apply_ffd(d, ffd_cols))
    return label(d, max_hold=max_hold)
