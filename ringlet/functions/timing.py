"""Timing of functions on the driver."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Timing:
    median: float
    iqr: float
    least: float
    runs: int


def timed(function: Callable[[], object], runs: int = 25, warm_up: int = 1) -> Timing:
    """CPU seconds of a call: median and interquartile range of ``runs``, after some that do not count."""
    for _ in range(warm_up):
        function()
    took = []
    for _ in range(runs):
        start = time.process_time()
        function()
        took.append(time.process_time() - start)
    q25, q50, q75 = np.percentile(took, [25, 50, 75])
    return Timing(float(q50), float(q75 - q25), min(took), runs)
