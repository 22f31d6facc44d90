"""Data-quality reports and cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidebar.operators.series import BLK, KEYS, in_blocks


def null_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL count and percentage per column, from one pass."""
    n = F.count(F.lit(1))
    wide = df.agg(n.alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.select("_n", F.expr(f"stack({len(cols)}, {pairs}) as (column, n_null)")).select(
        "column", "n_null", (F.lit(100.0) * F.col("n_null") / F.col("_n")).alias("pct_null"))


def zero_columns(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Per series and column: is every value zero?  One pass with map-side combine."""
    wide = df.groupBy(*keys).agg(*[
        F.coalesce(~F.bool_or(F.coalesce(F.col(c) != 0, F.lit(True))), F.lit(False)).alias(c)
        for c in cols])
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.select(*keys, F.expr(f"stack({len(cols)}, {pairs}) as (column, all_zero)"))


def date_range(df: DataFrame, keys: Sequence[str] = KEYS, time: str = "time") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.min(time).alias("first_time"),
                                 F.max(time).alias("last_time"))


def gaps(df: DataFrame, keys: Sequence[str] = KEYS, time: str = "time") -> DataFrame:
    """Days since the bar before (NULL on the first)."""
    return in_blocks(df, lambda d, w: d.withColumn(
        "gap_days", F.datediff(time, F.lag(time).over(w()))), keys=keys, back=1)


def continuity(df: DataFrame, max_gap_days: int = 10, keys: Sequence[str] = KEYS,
               time: str = "time") -> DataFrame:
    """Rows, largest gap, start, end and a flag per series."""
    g = F.coalesce(F.max("gap_days"), F.lit(0))
    return (gaps(df, keys, time).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_rows"), g.alias("max_gap"), F.min(time).alias("first_time"),
                 F.max(time).alias("last_time"), (g > max_gap_days).alias("has_gap")))


def newest_segment(df: DataFrame, max_gap_days: int = 30, keys: Sequence[str] = KEYS,
                   time: str = "time") -> DataFrame:
    """Keep the bars from the last gap longer than `max_gap_days` on (the bar after it included).

    Only the position of the last long gap is needed, so a grouped max replaces a running count.
    """
    keys = list(keys)
    marked = gaps(df, keys, time)
    start = marked.groupBy(*keys).agg(F.coalesce(F.max(
        F.when(F.col("gap_days") > max_gap_days, F.col("bar_idx"))), F.lit(0)).alias("_from"))
    return (marked.join(start, keys).filter(F.col("bar_idx") >= F.col("_from"))
            .drop("gap_days", "_from"))
