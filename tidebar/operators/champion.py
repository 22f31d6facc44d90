"""Champion selection by gates and a composite score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidebar.functions.expr import dbl

MIN_TRADES, MDD_GATE = 25, -0.20
WEIGHTS = {"alpha": 0.5, "cagr": 0.3, "sharpe": 0.2}


def scored(cands: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Best gate any candidate of the group passes, and the composite score among those.

    Gates: 2 = alive with enough trades and a small drawdown, 1 = alive, 0 = any.  The groups hold
    grid cells (models x banks x thresholds), a plan-time number.
    """
    g = Window.partitionBy(*groups)
    gate = (F.when(~F.col("is_dead") & (F.col("n") >= MIN_TRADES) & (F.col("mdd") > MDD_GATE), 2)
            .when(~F.col("is_dead"), 1).otherwise(0))
    d = (cands.withColumn("gate", gate).withColumn("_best", F.max("gate").over(g))
         .filter("gate = _best").drop("_best"))
    score = dbl(0.0)
    for col, weight in WEIGHTS.items():
        lo, hi = F.min(col).over(g), F.max(col).over(g)
        score = score + weight * F.when(hi > lo, (F.col(col) - lo) / (hi - lo)).otherwise(dbl(1.0))
    return d.withColumn("score", score)


def champions(cands: DataFrame, groups: Sequence[str], order: Sequence[str],
              need_alive: bool = False, digits: int = 9) -> DataFrame:
    """Highest score per group; ties go to the first in `order`.

    Scores are compared after rounding, so that the last bit cannot decide a tie.
    """
    d = scored(cands, groups)
    if need_alive:
        d = d.filter("gate > 0")
    w = Window.partitionBy(*groups).orderBy(F.round("score", digits).desc(), *order)
    return d.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
