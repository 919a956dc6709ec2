"""Arrays by number, kept in one flat array."""

from __future__ import annotations

import numpy as np

from .common import by_value

by_value(__name__)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The slices `flat[starts[c] : starts[c] + lengths[c]]` of every c in `codes`, joined."""
    n = lengths[codes]
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    first = np.repeat(starts[codes] - (ends - n), n)
    return flat[first + np.arange(ends[-1])]


class Slices:
    """Arrays by number, kept in one flat array."""

    def __init__(self, arrays: list[bytes], dtype: np.dtype):
        self.lengths = np.fromiter(map(len, arrays), np.int64, len(arrays)) // dtype.itemsize
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(arrays), dtype)

    @classmethod
    def of_lengths(cls, flat: np.ndarray, lengths: np.ndarray) -> Slices:
        """Slices of these lengths that follow each other in `flat`."""
        made = cls([], flat.dtype)
        made.flat, made.lengths = flat, lengths.astype(np.int64)
        made.starts = np.cumsum(made.lengths) - made.lengths
        return made

    def join(self, codes: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.starts, self.lengths, codes)
