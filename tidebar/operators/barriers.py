"""Triple-barrier outcome and label of every bar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidebar.functions.signals import stop_loss, take_profit
from tidebar.operators.series import KEYS, in_blocks

NEEDED = ("open", "high", "low", "close")


def _require(df: DataFrame, vol: str) -> None:
    missing = [c for c in (*NEEDED, vol, "bar_idx", "n_bars") if c not in df.columns]
    if missing:
        raise ValueError(f"columns needed for the triple barrier are missing: {missing}")


def _ahead(d: DataFrame, w, max_hold: int) -> DataFrame:
    nxt = w(1, max_hold)
    return d.withColumns({
        "_entry": F.lead("open", 1).over(w()),
        "_hi": F.collect_list("high").over(nxt),
        "_lo": F.collect_list("low").over(nxt),
        "_cl": F.lead("close", max_hold).over(w()),
    })


def _first(arr: str, test) -> F.Column:
    pos = F.array_position(F.transform(arr, test), True)
    return F.when(pos > 0, pos)


def outcomes(df: DataFrame, max_hold: int = 10, vol: str = "EGARCH_Vol",
             keys: Sequence[str] = KEYS, sides: Sequence[int] = (1, -1), unfinished: bool = False) -> DataFrame:
    """Exit of a trade opened after every bar, for each side.

    Entry is the next open, barriers come from the volatility at the signal bar.  Both barriers in
    one bar count as a stop.  Needs k_up, k_down, cost columns; `risk_mult` is used where present.
    Rows without `max_hold + 1` bars after them, or without volatility, have no outcome.  With `unfinished` every row that
    has a next bar has one: a trade that no bar so far ends has no exit kind, and `max_hold` as its longest duration.
    """
    _require(df, vol)
    v = F.col(vol)
    known = F.col("bar_idx") < F.col("n_bars") - (1 if unfinished else max_hold + 1)
    src = df if "risk_mult" in df.columns else df.withColumn("risk_mult", F.lit(1.0))

    def build(d, w):
        d = _ahead(d, w, max_hold)
        d = d.filter(known & v.isNotNull() & (v != 0))
        d = d.withColumn("side", F.explode(F.array(*[F.lit(s) for s in sides])))
        d = d.withColumns({"tp": take_profit(F.col("_entry"), v, F.col("k_up"), F.col("side")),
                           "sl": stop_loss(F.col("_entry"), v, F.col("k_down"), F.col("side"))})
        up_tp = _first("_hi", lambda h: h >= F.col("tp"))
        dn_tp = _first("_lo", lambda l: l <= F.col("tp"))
        dn_sl = _first("_lo", lambda l: l <= F.col("sl"))
        up_sl = _first("_hi", lambda h: h >= F.col("sl"))
        long_ = F.col("side") > 0
        return d.withColumns({"_jt": F.when(long_, up_tp).otherwise(dn_tp),
                              "_js": F.when(long_, dn_sl).otherwise(up_sl)})

    d = in_blocks(src, build, keys=keys, ahead=max_hold, size=4096)
    jt, js = F.col("_jt"), F.col("_js")
    over = F.when(F.col("bar_idx") + max_hold < F.col("n_bars"), "TIME")
    kind = (F.when(jt == js, "SL (Dual)").when(jt.isNull() & js.isNull(), over)
            .when(js.isNull() | (jt < js), "TP").otherwise("SL"))
    d = d.withColumns({"duration": F.coalesce(F.least(jt, js), F.lit(max_hold)).cast("int"),
                       "exit_kind": kind})
    level = (F.when(F.col("exit_kind") == "TP", F.col("tp"))
             .when(F.col("exit_kind") == "TIME", F.col("_cl"))
             .when(F.col("exit_kind").isNotNull(), F.col("sl")))
    raw = F.when(F.col("side") > 0, level / F.col("_entry") - 1).otherwise(F.col("_entry") / level - 1)
    fee = (1 - F.col("cost")) * (1 - F.col("cost"))
    d = d.withColumn("raw_ret", raw)
    return d.select(
        *keys, "time", "bar_idx", "n_bars", "side", F.col("_entry").alias("entry_price"), "tp", "sl",
        "exit_kind", "duration", (F.col("bar_idx") + F.col("duration")).alias("exit_idx"), "raw_ret",
        (((1 + F.col("raw_ret")) * fee - 1) * F.col("risk_mult")).alias("ret"))


def label(df: DataFrame, k_up: float = 2.0, k_down: float = 1.5, max_hold: int = 10,
          vol: str = "EGARCH_Vol", keys: Sequence[str] = KEYS) -> DataFrame:
    """Append `Label` (1: take-profit first; 0: stop, same bar or time) and `exit_kind`.

    The last max_hold + 1 rows of a series cannot be judged and are dropped.  Rows without
    volatility keep label 0 and have no exit kind.
    """
    _require(df, vol)
    v = F.col(vol)
    parameters = {"k_up": F.lit(k_up), "k_down": F.lit(k_down)}
    up = F.col("k_up") if "k_up" in df.columns else parameters["k_up"]
    down = F.col("k_down") if "k_down" in df.columns else parameters["k_down"]
    one = F.lit(1)

    def build(d, w):
        d = _ahead(d, w, max_hold).filter(F.col("bar_idx") < F.col("n_bars") - max_hold - 1)
        d = d.withColumns({"_tp": take_profit(F.col("_entry"), v, up, one),
                           "_sl": stop_loss(F.col("_entry"), v, down, one)})
        return d.withColumns({"_jt": _first("_hi", lambda h: h >= F.col("_tp")),
                              "_js": _first("_lo", lambda l: l <= F.col("_sl"))})

    d = in_blocks(df, build, keys=keys, ahead=max_hold, size=4096)
    jt, js = F.col("_jt"), F.col("_js")
    judged = v.isNotNull() & (v != 0)
    tp = judged & jt.isNotNull() & (js.isNull() | (jt < js))
    kind = F.when(judged, F.when(tp, "TP").when(js.isNotNull(), "SL").otherwise("TIME"))
    return (d.withColumns({"Label": F.when(tp, 1).otherwise(0), "exit_kind": kind})
            .drop("_entry", "_hi", "_lo", "_cl", "_tp", "_sl", "_jt", "_js"))


def label_distribution(labelled: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    hits = {k: F.count_if(F.col("exit_kind") == k) for k in ("TP", "SL", "TIME")}
    total = F.count("exit_kind")
    return (labelled.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_rows"), hits["TP"].alias("tp_hits"),
                 hits["SL"].alias("sl_hits"), hits["TIME"].alias("time_exits"),
                 F.when(total > 0, hits["TP"] / total).otherwise(0.0).alias("hit_ratio")))
