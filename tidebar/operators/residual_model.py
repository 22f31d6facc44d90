"""A two-stage direction classifier: what an ARMA filter leaves unexplained, beside exogenous lags.

Stage one chooses an order per series by AIC on the training rows and takes one-step residuals of every row from the
past alone.  Stage two learns, from windows of past residuals and of exogenous columns one row late, whether the
target rises, and is refitted every `step` test rows on everything before them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidebar.functions.expr import dbl
from tidebar.operators import arma, features, models
from tidebar.operators.indicators import WEIGHT_EPS
from tidebar.operators.series import KEYS, in_blocks, lagged
from tidebar.session import cut

INVERTIBLE = 0.98        # a moving-average term beyond this has no usable one-sided filter


def fit_filters(df: DataFrame, col: str, train: str = "is_train", keys: Sequence[str] = KEYS,
                p_values: Sequence[int] = (1, 2), q_values: Sequence[int] = (1,)) -> DataFrame:
    """keys, p, q, const, phi, theta of the order with the smallest AIC on the training rows, one row per series.

    Orders with a moving-average term beyond the limit are passed over; a series with none left gets the constant 0
    and no terms, so its residual is the series itself."""
    keys = list(keys)
    orders = arma.fit_orders(df.filter(train), col, keys, p_values, q_values)
    usable = orders.filter(F.forall("theta", lambda t: F.abs(t) <= INVERTIBLE))
    best = arma.best_order(usable, keys)
    none = F.array().cast("array<double>")
    return df.select(*keys).distinct().join(best.select(*keys, "p", "q", "const", "phi", "theta"), keys, "left").select(
        *keys, F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("q", F.lit(0)).alias("q"),
        F.coalesce("const", dbl(0.0)).alias("const"), F.coalesce("phi", none).alias("phi"), F.coalesce("theta", none).alias("theta"))


def residuals(df: DataFrame, col: str, filters: DataFrame, out: str = "resid", keys: Sequence[str] = KEYS) -> DataFrame:
    """One-step residual of every row under its series' filter (AR terms, at most one MA term).

    u_t = x_t - const - sum phi_i x_{t-i}; the innovation e_t = u_t - theta e_{t-1} is a geometric sum of past u, cut off
    where its weight vanishes for the largest theta.  Rows before the first p rows have residual 0.
    """
    keys = list(keys)
    filters = cut(filters)                                             # one row per series
    most = filters.agg(F.max("p").alias("p"), F.max(F.abs(F.get("theta", F.lit(0)))).alias("t"),
                       F.max(F.size("theta")).alias("q")).first()      # three numbers
    if (most["q"] or 0) > 1:
        raise ValueError("a filter with more than one moving-average term")
    p_max, theta = most["p"] or 0, most["t"] or 0.0
    depth = math.ceil(math.log(WEIGHT_EPS) / math.log(theta)) if theta > 1e-12 else 0
    d = df.join(filters.select(*keys, F.col("const").alias("_k"), F.col("phi").alias("_f"),
                               F.coalesce(F.get("theta", F.lit(0)), dbl(0.0)).alias("_m")), keys)

    def build(b, w):
        u = F.col(col) - F.col("_k")
        for i in range(1, p_max + 1):
            u = u - F.coalesce(F.get("_f", F.lit(i - 1)) * F.lag(col, i).over(w()), dbl(0.0))
        b = b.withColumn("_u", F.when(F.col("bar_idx") >= F.size("_f"), u).otherwise(dbl(0.0)))
        past = F.collect_list("_u").over(w(-depth, 0))
        back = lambda i: F.size("_h") - 1 - i
        return b.withColumn("_h", past).withColumn(out, F.aggregate(
            F.transform("_h", lambda x, i: x * F.pow(-F.col("_m"), back(i))), dbl(0.0), lambda s, x: s + x)).drop("_u", "_h")
    d = in_blocks(d, build, keys=keys, back=depth + p_max, size=max(4096, 4 * depth))
    return d.drop("_k", "_f", "_m")


def filtered(df: DataFrame, col: str, keys: Sequence[str] = KEYS, num: int = 4, den: int = 5, **orders) -> DataFrame:
    """`df` with is_train and the residual `resid` of `col`, written once: what any number of matrices start from."""
    d = df.withColumn("is_train", F.col("bar_idx") * den < F.col("n_bars") * num)
    return cut(residuals(d, col, fit_filters(d, col, keys=keys, **orders), keys=keys))


def matrix(df: DataFrame, col: str, exogenous: Sequence[str] = (), look_back: int = features.LOOK_BACK,
           keys: Sequence[str] = KEYS, num: int = 4, den: int = 5, start: DataFrame | None = None, **orders) -> DataFrame:
    """Training frame: features, Label (does `col` rise), is_train, test_idx; written once.  `df`: dense bar_idx, n_bars.
    Goes on from `start` where given, as `filtered` gave it for the same rows and split."""
    keys = list(keys)
    d = filtered(df, col, keys, num, den, **orders) if start is None else start
    rows = d.count()
    if exogenous:
        d = lagged(d, list(exogenous), 1, keys=keys)
    d = arma.direction(d, col, "Label", keys=keys)
    d = features.as_vector(features.lag_windows(d, ["resid", *exogenous], "Label", look_back, keys))
    first_test = F.ceil(F.col("n_bars") * num / den).cast("long")
    d = d.select(*keys, "bar_idx", "n_bars", "Label", "is_train", "features", (F.col("bar_idx") - first_test).alias("test_idx"))
    return cut(models.dealt(d, rows, look_back * (1 + len(exogenous)), *keys, "bar_idx"))


def walk_forward(frame: DataFrame, n_inputs: int, step: int = 60, kind: str = "NET", **params) -> DataFrame:
    """One score per test row from models that have seen only earlier rows; `frame` from `matrix`."""
    last = frame.agg(F.floor(F.max("test_idx") / step)).first()[0]       # one number: how many refits
    epochs = range(int(last) + 1) if last is not None and last >= 0 else []
    return models.walk_forward(frame, kind, n_inputs, epochs, step, 0, **params)
