"""Autoregressive order choice, residuals and direction targets.

Least squares needs only sums of products, so all series are fitted by one grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tidebar.functions.expr import dbl
from tidebar.operators.series import KEYS, in_blocks

LONG_AR = 6          # order of the first-pass regression that stands in for the innovations


def _gram(df: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return (df.na.drop(subset=list(names)).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n"),
                 F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).alias("g")))


def _unpack(g, size: int) -> np.ndarray:
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = g
    return m + m.T - np.diag(np.diag(m))


def _least_squares(m: np.ndarray, use: list[int], y: int):
    a, b = m[np.ix_(use, use)], m[use, y]
    beta = np.linalg.solve(a, b)
    return beta, float(max(m[y, y] - beta @ b, 1e-300))


def _fit(grams: DataFrame, keys: Sequence[str], key_fields, solve, out_fields) -> DataFrame:
    schema = T.StructType(list(key_fields) + out_fields)

    def run(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                for res in solve(rec["g"], rec["n"]):
                    rows.append({**{k: rec[k] for k in keys}, **res})
            yield pd.DataFrame(rows, columns=schema.names)
    return grams.mapInPandas(run, schema)


def fit_orders(df: DataFrame, col: str, keys: Sequence[str] = KEYS, p_values: Sequence[int] = (1, 2),
               q_values: Sequence[int] = (1,)) -> DataFrame:
    """AIC of every ARMA(p, q) with a constant, by two least-squares passes (Hannan-Rissanen).

    Pass 1: a long autoregression gives innovations.  Pass 2: regress on p lags and q innovations.
    """
    keys = list(keys)
    key_fields = [f for f in df.schema if f.name in keys]
    lag_names = [f"_y{i}" for i in range(1, LONG_AR + 1)]
    one = df.withColumns({"_one": dbl(1.0), "_y0": F.col(col).cast("double")})
    one = in_blocks(one, lambda d, w: d.withColumns(
        {f"_y{i}": F.lag("_y0", i).over(w()) for i in range(1, LONG_AR + 1)}), keys=keys, back=LONG_AR)
    names = ["_one", *lag_names, "_y0"]

    def long_ar(g, n):
        m = _unpack(g, len(names))
        beta, _ = _least_squares(m, list(range(len(names) - 1)), len(names) - 1)
        yield {"_b": beta.tolist()}

    first = _fit(_gram(one, names, keys), keys, key_fields, long_ar,
                 [T.StructField("_b", T.ArrayType(T.DoubleType()))])
    fitted = sum((F.col(c) * F.get("_b", F.lit(i)) for i, c in enumerate(names[:-1])), start=dbl(0.0))
    with_e = one.join(first, keys).withColumn("_e0", F.col("_y0") - fitted)
    q_max, p_max = max(q_values), max(p_values)
    with_e = in_blocks(with_e, lambda d, w: d.withColumns(
        {f"_e{j}": F.lag("_e0", j).over(w()) for j in range(1, q_max + 1)}), keys=keys, back=q_max)
    cols = ["_one", *[f"_y{i}" for i in range(1, p_max + 1)],
            *[f"_e{j}" for j in range(1, q_max + 1)], "_y0"]

    def choose(g, n):
        m = _unpack(g, len(cols))
        for p in p_values:
            for q in q_values:
                use = [0, *range(1, p + 1), *range(1 + p_max, 1 + p_max + q)]
                try:
                    beta, ssr = _least_squares(m, use, len(cols) - 1)
                except np.linalg.LinAlgError:
                    continue
                aic = n * (np.log(2 * np.pi * ssr / n) + 1) + 2 * (p + q + 2)
                yield {"p": p, "q": q, "n": int(n), "const": float(beta[0]),
                       "phi": beta[1:p + 1].tolist(), "theta": beta[p + 1:].tolist(), "aic": float(aic)}

    return _fit(_gram(with_e, cols, keys), keys, key_fields, choose, [
        T.StructField("p", T.IntegerType()), T.StructField("q", T.IntegerType()),
        T.StructField("n", T.LongType()), T.StructField("const", T.DoubleType()),
        T.StructField("phi", T.ArrayType(T.DoubleType())),
        T.StructField("theta", T.ArrayType(T.DoubleType())), T.StructField("aic", T.DoubleType())])


def best_order(orders: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    best = orders.groupBy(*keys).agg(F.min_by(
        F.struct("p", "q", "const", "phi", "theta", "aic"), F.col("aic")).alias("_b"))
    return best.select(*keys, "_b.*")


def one_step_residuals(df: DataFrame, col: str, const: float, phi: Sequence[float], theta: float = 0.0,
                       out: str = "resid", keys: Sequence[str] = KEYS) -> DataFrame:
    """Residual of the one-step forecast with fixed coefficients.

    u_t = x_t - const - sum phi_i x_{t-i} is a window projection; with an MA term the innovation is
    e_t = u_t - theta e_{t-1}, a geometric sum of past u with |theta| < 1 that is cut off where its
    weight vanishes.  Rows without enough history start the recursion at 0.
    """
    from tidebar.operators.indicators import WEIGHT_EPS
    import math
    p = len(phi)
    depth = 0 if theta == 0 else math.ceil(math.log(WEIGHT_EPS) / math.log(abs(theta)))
    powers = [(-theta) ** j for j in range(depth, -1, -1)]

    def build(d, w):
        u = F.col(col) - dbl(const)
        for i, c in enumerate(phi, start=1):
            u = u - dbl(c) * F.lag(col, i).over(w())
        d = d.withColumn("_u", F.when(F.col("bar_idx") >= p, u))
        if depth == 0:
            return d.withColumn(out, F.coalesce("_u", dbl(0.0))).drop("_u")
        window = F.collect_list(F.coalesce("_u", dbl(0.0))).over(w(-depth, 0))
        ws = F.array(*[dbl(v) for v in powers])
        tail = F.slice(ws, -F.size("_h"), F.size("_h"))
        return (d.withColumn("_h", window)
                .withColumn(out, F.aggregate(F.zip_with(tail, "_h", lambda a, b: a * b), dbl(0.0),
                                             lambda s, x: s + x)).drop("_u", "_h"))
    return in_blocks(df, build, keys=keys, back=depth + p, size=max(4096, 4 * depth))


def direction(df: DataFrame, col: str, out: str = "up", keys: Sequence[str] = KEYS) -> DataFrame:
    """1 where the target rises against the row before; the first row is 0."""
    return in_blocks(df, lambda d, w: d.withColumn(out, F.when(
        F.col(col) > F.lag(col).over(w()), 1).otherwise(0)), keys=keys, back=1)
