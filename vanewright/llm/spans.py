"""Removing spans of items (bytes or words) that were found per document."""

from __future__ import annotations

import numpy as np


def merged_runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by spans; overlapping and adjacent spans are one run."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    last = np.concatenate((new[1:], [True]))
    return start[new], end[last]


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n items lie in a span."""
    change = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] > 0
