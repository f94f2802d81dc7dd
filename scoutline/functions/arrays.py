"""Vectors of Arrow batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The lists of a column as rows of doubles; shorter ones are filled with zeros, nulls in them too, longer ones cut."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(lists), width))
    if len(lists):
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False).astype(float))
        row = np.repeat(np.arange(len(lists)), lengths)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[row[at < width], at[at < width]] = flat[at < width]
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; zeros stay."""
    norm = np.sqrt((rows * rows).sum(axis=1))
    return rows / np.where(norm > 0, norm, 1)[:, None]


def kmeans(rows: np.ndarray, n: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """n centres of rows, or as many as there are different rows if these are fewer; an empty centre takes the row that is farthest from its own."""
    different = np.unique(rows, axis=0)
    n = min(n, len(different))
    centres = different[np.random.default_rng(seed).permutation(len(different))[:n]].copy()
    for _ in range(rounds):
        own, far = closest(rows, centres)
        count = np.bincount(own, minlength=n)
        total = np.zeros_like(centres)
        np.add.at(total, own, rows)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        for c in np.flatnonzero(count == 0):
            i = int(far.argmax())
            centres[c], far[i] = rows[i], -1
    return centres


def closest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The closest centre of each row, and the square of its distance but for the row's own length."""
    d = (centres * centres).sum(axis=1) - 2 * rows @ centres.T
    own = d.argmin(axis=1)
    return own, d[np.arange(len(rows)), own] + (rows * rows).sum(axis=1)
