"""Sequential search of a parameter grid: each trial is proposed from the scores of the trials before it.

The tried points are split into the best share and the rest.  Of each parameter, both sides give a density over its
values (kernels on the order of numbers, counts of names, a uniform prior); the point proposed is, among draws from the
first density, the one with the largest ratio to the second.  The history is one row per trial, so this is a driver's
small decision; what a trial costs, the fits, is Spark's.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from itertools import product
from statistics import median

GOOD_SHARE = 0.25
STARTUP = 4
DRAWS = 24

Point = dict[str, object]


def _density(values: Sequence, seen: Sequence) -> list[float]:
    """Probability of each value: a uniform prior worth one point, and a kernel around each point seen."""
    total = [1.0 / len(values)] * len(values)
    ordered = all(isinstance(v, (int, float)) for v in values)
    reach = max(1.0, len(values) / (1 + len(seen)))
    for value in seen:
        at = values.index(value)
        kernel = [math.exp(-0.5 * ((k - at) / reach) ** 2) if ordered else float(k == at) for k in range(len(values))]
        whole = sum(kernel)
        total = [t + k / whole for t, k in zip(total, kernel)]
    return [t / (1 + len(seen)) for t in total]


def propose(grid: Mapping[str, Sequence], history: Sequence[tuple[Point, float]], seed: int = 42,
            startup: int = STARTUP) -> Point | None:
    """The next point, one not tried before; None when the grid is used up.

    The first `startup` points are drawn evenly.  A repeated call with the same history gives the same point.
    """
    names = sorted(grid)
    tried = {tuple(p[n] for n in names) for p, _ in history}
    if len(tried) >= math.prod(len(grid[n]) for n in names):
        return None
    rng = random.Random(f"{seed}/{len(history)}")
    uniform = lambda: tuple(rng.choice(list(grid[n])) for n in names)
    if len(history) < startup:
        point = uniform()
        while point in tried:
            point = uniform()
        return dict(zip(names, point))
    ranked = sorted(history, key=lambda h: -h[1])
    cut = max(1, math.ceil(GOOD_SHARE * len(ranked)))
    good = {n: _density(list(grid[n]), [p[n] for p, _ in ranked[:cut]]) for n in names}
    rest = {n: _density(list(grid[n]), [p[n] for p, _ in ranked[cut:]]) for n in names}
    gain = lambda point: sum(math.log(good[n][k] / rest[n][k]) for n, v in zip(names, point)
                             for k in [list(grid[n]).index(v)])
    draws = [tuple(rng.choices(list(grid[n]), good[n])[0] for n in names) for _ in range(DRAWS)]
    fresh = [d for d in draws if d not in tried] or [c for c in product(*(grid[n] for n in names)) if c not in tried]
    return dict(zip(names, max(fresh, key=gain)))


def hopeless(scores: Sequence[float], before: Sequence[Sequence[float]], startup: int = STARTUP) -> bool:
    """Whether a trial's mean so far is under the median of earlier trials' means after as many folds."""
    peers = [sum(s[:len(scores)]) / len(scores) for s in before if len(s) >= len(scores)]
    return bool(scores) and len(peers) >= startup and sum(scores) / len(scores) < median(peers)
