"""Feature banks, lagged windows and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from tidebar.functions.expr import clip, dbl
from tidebar.operators.series import KEYS, clean_non_finite, fill, in_blocks

LOOK_BACK = 60

# Substrings that tell the asset class, and the columns of each feature bank.
FX = ("EUR", "USD", "GBP", "JPY", "AUD", "NZD", "CAD", "CHF", "MXN", "NOK", "SEK", "SGD")
NOT_FX = ("SP500", "US500", "NAS100", "US100")
INDEX = ("SP500", "US500", "NAS100", "US100", "GER40", "DE40", "UK100", "JPN225", "IPSA")
METAL = ("ORO", "XAUUSD", "PLATA", "XAGUSD")
ENERGY = ("WTI", "XTIUSD", "XBRUSD", "BRENT")
PRICE = ("open_FFD", "high_FFD", "low_FFD")
TECH = ("MACD_Hist", "RSI", "ATR", "EGARCH_Vol")
MACRO = {"fx": ("Yield10Y_FFD",), "index": ("Yield10Y_FFD",),
         "metal": ("Yield10Y_FFD", "DXY_close_FFD"), "energy": ("DXY_close_FFD",),
         "other": ("Yield10Y_FFD",)}
GLOBAL = {"fx": ("DXY_close_FFD", "VIX_close"), "index": ("VIX_close", "DXY_close_FFD"),
          "metal": ("VIX_close",), "energy": ("VIX_close",), "other": ("VIX_close", "DXY_close_FFD")}


def asset_class(symbol: Column) -> Column:
    """fx, index, metal, energy or other, by substrings of the part before the first underscore."""
    base = F.upper(F.split(symbol, "_")[0])
    has = lambda words: base.rlike("|".join(words))
    return (F.when(has(FX) & ~has(NOT_FX), "fx").when(has(INDEX), "index").when(has(METAL), "metal")
            .when(has(ENERGY), "energy").otherwise("other"))


def banks(kind: str) -> dict[str, tuple[str, ...]]:
    return {"Precio_Puro": PRICE, "Precio_Volumen": PRICE + ("tick_volume",), "Tecnicos": TECH,
            "Macros": MACRO[kind], "Globales": GLOBAL[kind],
            "Hibrido_Precio_Tec_Vol": PRICE + TECH + ("tick_volume",)}


def bank_columns(symbols: DataFrame) -> DataFrame:
    """(symbol, asset_class, bank, position, column)."""
    d = symbols.withColumn("asset_class", asset_class(F.col("symbol")))
    table = F.create_map(*[x for kind in MACRO for x in (F.lit(kind), F.array(*[
        F.struct(F.lit(b).alias("bank"), F.array(*[F.lit(c) for c in cols]).alias("cols"))
        for b, cols in banks(kind).items()]))])
    return (d.withColumn("_b", F.explode(table[F.col("asset_class")]))
            .select("symbol", "asset_class", F.col("_b.bank").alias("bank"),
                    F.posexplode("_b.cols").alias("position", "column")))


def lag_windows(df: DataFrame, cols: Sequence[str], label: str | None = "Label",
                look_back: int = LOOK_BACK, keys: Sequence[str] = KEYS, clean: bool = True,
                out: str = "window") -> DataFrame:
    """Flat array of the `look_back` rows before each row, oldest first; rows without are dropped.

    The 60x copy of the features only exists inside the block that a task is working on and in the
    rows handed to training; it is never shuffled.
    """
    cols = [c for c in cols if c != label]
    d = fill(clean_non_finite(df, cols), cols, keys=keys) if clean else df
    row = F.array(*[F.col(c).cast("double") for c in cols])

    def build(b, w):
        return b.withColumn(out, F.flatten(F.collect_list(row).over(w(-look_back, -1))))
    d = in_blocks(d, build, keys=keys, back=look_back)
    return d.filter(F.col("bar_idx") >= look_back)


def as_vector(df: DataFrame, col: str = "window", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(col))


def train_split(df: DataFrame, share_num: int = 4, share_den: int = 5) -> DataFrame:
    """Mark the first 80 % of each series as training rows."""
    return df.withColumn("is_train", F.col("bar_idx") * share_den < F.col("n_bars") * share_num)


def standardise(df: DataFrame, cols: Sequence[str], train: str = "is_train", bound: float = 10.0,
                keys: Sequence[str] = KEYS) -> DataFrame:
    """z-scores from the training rows' mean and population deviation, clipped to +-bound."""
    stats = df.filter(train).groupBy(*keys).agg(*[
        e for c in cols for e in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    d = df.join(stats, list(keys))
    z = {f"{c}_z": clip((F.col(c) - F.col(f"_m_{c}"))
                        / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(dbl(1.0)),
                        -bound, bound) for c in cols}
    return d.withColumns(z).drop(*[f"_{p}_{c}" for c in cols for p in "ms"])


def exogenous_block(df: DataFrame, target: str, cols: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Target with the exogenous columns of the row before; incomplete rows are dropped."""
    d = in_blocks(df, lambda b, w: b.withColumns({c: F.lag(c).over(w()) for c in cols}),
                  keys=keys, back=1)
    return d.na.drop(subset=[target, *cols])
