"""Cutting Arrow batches of texts by their bytes (no pandas: workers that count bytes import this)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handed to an encoder at once.
PIECE_BYTES = 1 << 20


def pieces(column: pa.Array, rows: int | None = None, size: int = PIECE_BYTES) -> list[tuple[int, int]]:
    """Bounds (from, to) of runs of a text column: ``size`` bytes beside the longest text, ``rows`` rows at most."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    cuts = np.flatnonzero(np.diff(ends // size)) + 1 if len(ends) else []
    bounds = [0, *map(int, cuts), len(column)]
    return [(a, min(a + (rows or len(column)), j)) for i, j in zip(bounds, bounds[1:]) for a in range(i, j, rows or len(column))]
