"""Helpers for ragged arrays inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The concatenation of ``flat[starts[i] : starts[i] + lens[i]]`` for i in ``pick``."""
    n = lens[pick]
    total = int(n.sum())
    if not total:
        return flat[:0]
    begin = np.cumsum(n) - n
    return flat[np.repeat(starts[pick] - begin, n) + np.arange(total)]


def offsets(lens: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    return out


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about ``most`` bytes of text each (one row at least)."""
    for batch in batches:
        size = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def long_list(flat: np.ndarray, lens: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets(lens).astype(np.int32)), pa.array(flat, kind))
