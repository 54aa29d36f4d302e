"""Bootstrap intervals of small groups, drawn by a seeded Mersenne twister; their three rules for the ends differ."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence


def resampled(values: Sequence[float], samples: int, seed: int) -> list[float]:
    """Sorted means of resamples of the values."""
    rng, n = random.Random(seed), len(values)
    return sorted(math.fsum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(samples))


def ends_by_count(draws: Sequence[float]) -> tuple[float, float]:
    """Places floor(p * count), kept within the draws."""
    n = len(draws)
    return tuple(draws[min(max(int(p * n), 0), n - 1)] for p in (0.025, 0.975))


def ends_by_last(draws: Sequence[float]) -> tuple[float, float]:
    """Places floor(p * (count - 1))."""
    return tuple(draws[int(p * (len(draws) - 1))] for p in (0.025, 0.975))


def ends_paired(draws: Sequence[float]) -> tuple[float, float]:
    """Place floor(0.025 * count), and the one before floor(0.975 * count)."""
    return draws[int(0.025 * len(draws))], draws[int(0.975 * len(draws)) - 1]


def mean_interval(values: Sequence[float], samples: int = 10_000, seed: int = 140, ends: Callable = ends_by_count) -> tuple[float, float, float]:
    """(mean, low, high) of values, which must not be empty."""
    if not values or samples < 100:
        raise ValueError("values, and at least 100 samples, are needed")
    return (math.fsum(values) / len(values), *ends(resampled(values, samples, seed)))
