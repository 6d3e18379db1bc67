"""Valid vectors of an embedding table, shared by the two vector operators.

A vector takes part when it is not null, not empty, not zero and holds no null or non-finite
component. Cosines are taken in double precision on the original components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Vectors:
    """A list column as flat doubles; ``ok`` marks the valid rows."""

    def __init__(self, column: pa.Array):
        n = len(column)
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten()
        self.flat = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        with np.errstate(invalid="ignore", over="ignore"):
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(self.flat))])
            some = np.concatenate([[0], np.cumsum(self.flat != 0)])
        at = self.bounds
        self.ok = (sizes > 0) & (bad[at[1:]] == bad[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
        self.sizes = sizes
        self.n = n

    def row(self, i: int) -> np.ndarray:
        return self.flat[self.bounds[i]: self.bounds[i + 1]]

    def by_size(self):
        """(row numbers, matrix) of the valid rows for every length that occurs."""
        for size in np.unique(self.sizes[self.ok]):
            at = np.flatnonzero(self.ok & (self.sizes == size))
            yield at, self.flat[self.bounds[at][:, None] + np.arange(size)]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; by the largest component first, so squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
