"""Sums by id of rows that travel as arrays, many in a message."""

from __future__ import annotations

import numpy as np


def grouped(ids: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct ids ascending, and the sums of each one's values."""
    if not len(ids):
        return ids, *values
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    return ids[starts], *(np.add.reduceat(v[order], starts, axis=0) for v in values)
