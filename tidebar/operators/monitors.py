"""Regime and anomaly monitors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, functions as F, types as T

from tidebar.functions.expr import dbl

CRISIS_MULT = 0.5


def regimes(df: DataFrame, cols: Sequence[str], k: int = 3, train: str | None = None) -> DataFrame:
    """Mixture regime of every row; the component with the largest total variance is the crisis.

    Adds `regime`, `is_crisis` and the risk multiplier.
    """
    asm = VectorAssembler(inputCols=list(cols), outputCol="_x", handleInvalid="skip").transform(df)
    fit_on = asm.filter(train) if train else asm
    scaler = StandardScaler(inputCol="_x", outputCol="_z", withMean=True).fit(fit_on)
    gm = GaussianMixture(featuresCol="_z", predictionCol="regime", k=k, seed=42, maxIter=100)
    model = gm.fit(scaler.transform(fit_on))
    traces = [float(sum(g.cov.toArray().diagonal())) for g in model.gaussians]     # k numbers
    crisis = traces.index(max(traces))
    out = model.transform(scaler.transform(asm)).drop("_x", "_z", "probability")
    return out.withColumn("is_crisis", F.col("regime") == crisis).withColumn(
        "risk_mult", F.when(F.col("is_crisis"), dbl(CRISIS_MULT)).otherwise(dbl(1.0)))


def _projections(grams: DataFrame, keys: Sequence[str], d: int, k: int) -> DataFrame:
    """Per key: mean, deviation and the projection on the k leading directions of its correlation matrix."""
    fields = [f for f in grams.schema if f.name in keys]
    schema = T.StructType(fields + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("_mean", "_sd", "_proj")])

    def solve(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                n, mean = rec["_n"], np.array(rec["_s"], float) / rec["_n"]
                cov = np.zeros((d, d))
                cov[np.triu_indices(d)] = np.array(rec["_q"], float) / n
                cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
                sd = np.sqrt(np.clip(np.diag(cov), 0, None))
                sd[sd < 1e-12 * np.maximum(1, np.abs(mean))] = 0
                with np.errstate(divide="ignore", invalid="ignore"):
                    corr = np.where(np.outer(sd, sd) > 0, cov / np.outer(sd, sd), 0)
                _, vectors = np.linalg.eigh(corr)
                lead = vectors[:, ::-1][:, :k]
                rows.append({**{x: rec[x] for x in keys}, "_mean": mean, "_sd": sd, "_proj": (lead @ lead.T).ravel()})
            yield pd.DataFrame(rows, columns=schema.names)
    return grams.mapInPandas(solve, schema)


def reconstruction_error(df: DataFrame, cols: Sequence[str], k: int = 2, train: str | None = None,
                         keys: Sequence[str] = ()) -> DataFrame:
    """Mean squared error per row of a linear autoencoder on standardised columns, one model per key.

    A key's training rows are added up to sums and products, so a key with most rows is no larger a task than another;
    the eigenvectors of its small matrix are the model.  Columns that do not vary in training are left out of the error;
    rows of a key without training rows have none.
    """
    keys, d = list(keys), len(cols)
    on = keys or ["_one"]
    base = df if keys else df.withColumn("_one", F.lit(0))
    rows = base.filter(train) if train else base
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    grams = rows.na.drop(subset=list(cols)).groupBy(*on).agg(
        F.count(F.lit(1)).alias("_n"), F.array(*[F.sum(F.col(c).cast("double")) for c in cols]).alias("_s"),
        F.array(*[F.sum(F.col(a).cast("double") * F.col(b).cast("double")) for a, b in pairs]).alias("_q"))
    j = base.join(_projections(grams, on, d, k), on, "left")
    at = lambda name, i: F.get(name, F.lit(i))
    z = [F.when(at("_sd", i) > 0, (F.col(c) - at("_mean", i)) / at("_sd", i)).when(at("_sd", i) == 0, dbl(0.0))
         for i, c in enumerate(cols)]
    j = j.withColumn("_z", F.array(*z))
    err = dbl(0.0)
    for i in range(d):
        rebuilt = sum((at("_proj", i * d + m) * at("_z", m) for m in range(d)), start=dbl(0.0))
        err = err + F.when(at("_sd", i) > 0, F.pow(at("_z", i) - rebuilt, dbl(2.0))).otherwise(dbl(0.0))
    return j.withColumn("mse", F.when(F.col("_sd").isNotNull(), err / d)).drop("_mean", "_sd", "_proj", "_z", "_one")


def error_thresholds(errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """P90 and P99 of the training errors per strategy."""
    from tidebar.operators.metrics import group_quantile
    p90 = group_quantile(errors, keys, "mse", 0.90, "p90", width=0.05)
    p99 = group_quantile(errors, keys, "mse", 0.99, "p99", width=0.05)
    return p90.join(p99, list(keys))


def concept_drift(errors: DataFrame, thresholds: DataFrame, keys: Sequence[str], last: int = 30,
                  order: str = "trade_no", n: str = "n_trades") -> DataFrame:
    """Is the median error of the newest `last` trades above P90?  Fewer trades give no verdict."""
    keys = list(keys)
    recent = errors.filter((F.col(order) >= F.col(n) - last) & (F.col(n) >= last))
    return (recent.groupBy(*keys).agg(F.median("mse").alias("median_mse"))
            .join(thresholds.select(*keys, "p90"), keys)
            .withColumn("drift", F.col("median_mse") > F.col("p90")))
