"""Shared session and seeded frames with known shapes."""

import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidebar.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def walk(seed, n, drift, sigma, start, symbol="AAA", vol=(0.3, 0.8), spread=0.004):
    rng = np.random.default_rng(seed)
    close = start * np.cumprod(1 + rng.normal(drift, sigma, n))
    return pd.DataFrame({
        "symbol": symbol, "time": pd.bdate_range("2018-01-01", periods=n).date,
        "bar_idx": np.arange(n), "n_bars": n, "open": close * (1 + rng.normal(0, spread / 4, n)),
        "high": close * (1 + rng.uniform(spread / 4, spread, n)),
        "low": close * (1 - rng.uniform(spread / 4, spread, n)), "close": close,
        "tick_volume": rng.integers(1000, 5000, n), "EGARCH_Vol": rng.uniform(*vol, n)})


# Seeds, lengths, drifts, deviations and starts of the frames below.
@pytest.fixture(scope="session")
def bull():
    return walk(42, 200, 0.005, 0.002, 1.10)


@pytest.fixture(scope="session")
def crash():
    return walk(123, 200, -0.008, 0.003, 1.20, vol=(0.5, 1.5))


@pytest.fixture(scope="session")
def flat():
    return walk(99, 200, 0.0, 0.00005, 1.15, vol=(0.1, 0.3), spread=0.0004)


@pytest.fixture(scope="session")
def clean():
    return walk(7, 600, 0.0003, 0.01, 100.0)


@pytest.fixture(scope="session")
def long_walk():
    """Two series long enough to span several blocks of every operator."""
    return pd.concat([walk(1, 9000, 0.0, 0.006, 100.0, "AAA"), walk(2, 5000, 0.0001, 0.006, 50.0, "BBB")],
                     ignore_index=True)
