"""Bootstrap drawdown of trade sequences, deterministic and distributed.

A path draws `n` returns with replacement.  The draw of position p in simulation s is an integer
hash of (s, p), so every engine and every retry of a lost task gives the same path.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidebar.functions.expr import dbl
from tidebar.operators.series import spread

# Fixed values of the hash.
PRIME = 2147483647
SIM_CHUNK = 50
CELLS = 1 << 21      # numbers of a piece of paths worked on at a time


def draw(sim, pos, n):
    """Index in 0..n-1: two squarings modulo a Mersenne prime.  Takes columns or integer arrays."""
    h = (sim * 1000003 + pos * 10007 + 12345) % PRIME
    h = (h * h) % PRIME
    h = (h * 48271 + 11) % PRIME
    return ((h * h) % PRIME) % n


def _drawdowns(values: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """Max drawdown of each simulation's path through as many draws as there are values, piece by piece of the paths:
    value and peak are carried on, so memory does not grow with a path's length."""
    n = len(values)
    value, peak, worst = np.ones(len(sims)), np.full(len(sims), -np.inf), np.full(len(sims), np.inf)
    step = max(1, CELLS // len(sims))
    for a in range(0, n, step):
        pick = draw(sims[:, None], np.arange(a, min(n, a + step), dtype=np.int64)[None, :], n)
        path = value[:, None] * np.cumprod(1 + values[pick], axis=1)
        high = np.maximum(np.maximum.accumulate(path, axis=1), peak[:, None])
        worst = np.minimum(worst, (path / high - 1).min(axis=1))
        value, peak = path[:, -1], high[:, -1]
    return worst


def _paths(batches: Iterator[pd.DataFrame], names: list[str], n_sims: int) -> Iterator[pd.DataFrame]:
    """Drawdowns of `SIM_CHUNK` paths per input row."""
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            first = int(row[-1])
            sims = np.arange(first * SIM_CHUNK, min((first + 1) * SIM_CHUNK, n_sims), dtype=np.int64)
            part = pd.DataFrame({"sim": sims, "mdd": _drawdowns(np.asarray(row[len(names)], float), sims)})
            for i, c in enumerate(names):
                part[c] = row[i]
            out.append(part[[*names, "sim", "mdd"]])
        if out:
            yield pd.concat(out)


def path_drawdowns(returns: DataFrame, specs: DataFrame, keys: Sequence[str],
                   extra: Sequence[str] = (), n_sims: int = 1000) -> DataFrame:
    """Max drawdown of every simulated path.

    `returns`: keys, trade_no (dense), ret.  `specs`: keys, `extra`, n - each row asks for paths
    drawn from the first n returns of its key.  A draw may be any of them, so a key's returns travel as one array
    (8 bytes a trade) with every chunk of `SIM_CHUNK` simulations, and chunks are spread over tasks.
    """
    keys, extra = list(keys), list(extra)
    arrays = returns.groupBy(*keys).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("trade_no", "ret"))), lambda x: x["ret"]).alias("_r"))
    chunks = F.explode(F.sequence(F.lit(0), F.lit((n_sims - 1) // SIM_CHUNK)))
    asked = (specs.filter(F.col("n") > 0).join(arrays, keys)
             .select(*keys, *extra, F.slice("_r", F.lit(1), F.col("n").cast("int")).alias("_r"), chunks.alias("_chunk")))
    types = dict(asked.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, *extra]) + ", sim bigint, mdd double"
    return spread(asked, *keys, *extra, "_chunk").mapInPandas(
        lambda batches: _paths(batches, [*keys, *extra], n_sims), schema)


def bootstrap_mdd(returns: DataFrame, specs: DataFrame, keys: Sequence[str],
                  extra: Sequence[str] = (), n_sims: int = 1000, q: float = 0.05) -> DataFrame:
    """The q-quantile of the simulated drawdowns (n_sims values per group, a fixed number)."""
    return (path_drawdowns(returns, specs, keys, extra, n_sims)
            .groupBy(*keys, *extra)
            .agg(F.percentile("mdd", dbl(q)).alias("mc_mdd_95")))
