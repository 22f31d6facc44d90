"""Cross-validation membership and the combinatorial overfitting audit."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from tidebar.functions.expr import dbl
from tidebar.operators.metrics import ANNUAL


def group_id(idx: Column, n: Column, n_groups: int) -> Column:
    """Equal groups of n // n_groups rows; the last takes the remainder."""
    return F.least(F.floor(idx / F.floor(n / n_groups)), F.lit(n_groups - 1).cast("long"))


def paths(n_groups: int = 6, k_test: int = 2) -> list[tuple[int, tuple[int, ...]]]:
    """(path number, test groups): a plan constant."""
    return list(enumerate(combinations(range(n_groups), k_test)))


def _path_column(n_groups: int, k_test: int) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("path"), F.array(*[F.lit(g) for g in t]).alias("test"))
                     for i, t in paths(n_groups, k_test)])


def cpcv_membership(df: DataFrame, n_groups: int = 6, k_test: int = 2, purge: int = 10,
                    idx: str = "bar_idx", n: str = "n_bars") -> DataFrame:
    """Role of every row on every path: test, train, or purged (dropped).

    A training row is purged when it lies within `purge` rows of a neighbouring test group.
    """
    size = F.floor(F.col(n) / n_groups)
    d = (df.withColumn("group_id", group_id(F.col(idx), F.col(n), n_groups))
         .withColumn("_lo", F.col("group_id") * size)
         .withColumn("_hi", F.when(F.col("group_id") == n_groups - 1, F.col(n))
                     .otherwise((F.col("group_id") + 1) * size))
         .withColumn("_p", F.explode(_path_column(n_groups, k_test)))
         .select("*", "_p.path", "_p.test"))
    has = lambda g: F.exists("test", lambda t: t == g)
    is_test = has(F.col("group_id"))
    near = ((has(F.col("group_id") - 1) & (F.col(idx) < F.col("_lo") + purge))
            | (has(F.col("group_id") + 1) & (F.col(idx) >= F.col("_hi") - purge)))
    role = F.when(is_test, "test").when(~near, "train")
    return d.withColumn("role", role).filter("role is not null").drop("_lo", "_hi", "_p", "test")


def purged_folds(df: DataFrame, n_splits: int = 3, purge: int = 60, embargo: int = 10,
                 idx: str = "bar_idx", n: str = "n_bars") -> DataFrame:
    """Role (train / val) of every row in every fold; rows in the purge or embargo gap are left out."""
    size = F.floor(F.col(n) / n_splits)
    d = df.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(n_splits)])))
    lo = F.col("fold") * size
    hi = F.when(F.col("fold") == n_splits - 1, F.col(n)).otherwise(lo + size)
    i = F.col(idx)
    role = (F.when((i >= lo) & (i < hi), "val")
            .when((i < lo - purge) | (i >= hi + embargo), "train"))
    return d.withColumn("role", role).filter("role is not null")


def path_sharpes(df: DataFrame, keys: Sequence[str], ret: str = "ret", n_groups: int = 6,
                 k_test: int = 2, idx: str = "bar_idx", n: str = "n_bars") -> DataFrame:
    """Annualised Sharpe of the test rows of every path.

    Rows are reduced to (count, sum, sum of squares) per group with map-side combine; the paths are
    then built from `n_groups` rows per key instead of from copies of every bar.
    """
    keys = list(keys)
    groups = (df.withColumn("group_id", group_id(F.col(idx), F.col(n), n_groups))
              .groupBy(*keys, "group_id")
              .agg(F.count(ret).alias("_n"), F.sum(ret).alias("_s"),
                   F.sum(F.col(ret) * F.col(ret)).alias("_q")))
    per_path = (groups.withColumn("_p", F.explode(_path_column(n_groups, k_test)))
                .filter(F.exists("_p.test", lambda t: t == F.col("group_id")))
                .groupBy(*keys, F.col("_p.path").alias("path"))
                .agg(F.sum("_n").alias("n"), F.sum("_s").alias("_s"), F.sum("_q").alias("_q")))
    mean = F.col("_s") / F.col("n")
    var = F.col("_q") / F.col("n") - mean * mean
    sr = F.when((F.col("n") < 5) | (var <= 1e-18), dbl(0.0)).otherwise(mean / F.sqrt(var) * ANNUAL)
    return per_path.select(*keys, "path", "n", sr.alias("sharpe"))


def pbo(sharpes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of paths without a positive Sharpe, its spread and verdict."""
    p = F.avg(F.when(F.col("sharpe") <= 0, 1.0).otherwise(0.0))
    out = sharpes.groupBy(*keys).agg(
        p.alias("pbo"), F.avg("sharpe").alias("sharpe_mean"), F.stddev_pop("sharpe").alias("sharpe_std"),
        F.min("sharpe").alias("sharpe_min"), F.max("sharpe").alias("sharpe_max"),
        F.count(F.lit(1)).alias("n_paths"))
    return out.withColumn("verdict", F.when(F.col("pbo") < 0.05, "robust")
                          .when(F.col("pbo") < 0.20, "acceptable").otherwise("overfit"))


def audit(df: DataFrame, keys: Sequence[str], threshold: float = 0.5, n_groups: int = 6,
          k_test: int = 2, min_rows: int = 100, signal_lag: int = 0) -> DataFrame:
    """CPCV audit of long-only scores: needs keys, bar_idx (dense), n_bars, prob, ret.

    Short series give zeros.  `signal_lag` of 1 trades the next bar instead of the same one.
    """
    from tidebar.operators.series import lagged
    keys = list(keys)
    d = lagged(df, ["prob"], signal_lag, keys=keys) if signal_lag else df
    d = d.withColumn("_sr", F.when(F.col("prob") > threshold, F.col("ret")).otherwise(dbl(0.0)))
    enough = F.col("n_bars") >= min_rows
    full = pbo(path_sharpes(d.filter(enough), keys, "_sr", n_groups, k_test), keys)
    short = d.filter(~enough).select(*keys).distinct()
    zero = dbl(0.0)
    return full.unionByName(short.select(
        *keys, zero.alias("pbo"), zero.alias("sharpe_mean"), zero.alias("sharpe_std"),
        zero.alias("sharpe_min"), zero.alias("sharpe_max"), F.lit(0).cast("long").alias("n_paths"),
        F.lit("robust").alias("verdict")))
