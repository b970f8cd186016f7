"""Words of many texts at once, as codes into their distinct words, by Arrow kernels."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Words(NamedTuple):
    unique: pa.Array  # distinct words
    codes: np.ndarray  # of each word of the texts, in order
    bounds: np.ndarray  # where the words of each text begin, and the end

    def bodies(self) -> list[bytes]:
        return self.unique.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def split(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """(words, bounds). Words are what blanks (space, \\t, \\n, \\v, \\f, \\r) separate, as for bytes.split(); null is empty."""
    texts = texts.fill_null("")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, bounds = parts.flatten(), np.concatenate([[0], np.cumsum(sizes)])
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # before the first and after the last word
    if empty.any():
        flat = flat.filter(pa.array(~empty))
        bounds = bounds - np.concatenate([[0], np.cumsum(empty)])[bounds]
    return flat, bounds


def encoded(flat: pa.Array, bounds: np.ndarray) -> Words:
    found = flat.dictionary_encode()
    return Words(found.dictionary, found.indices.to_numpy(zero_copy_only=False), bounds)


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    return encoded(*split(texts, lower))


def ranges(texts: pa.Array, size: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Successive ranges of texts of about `size` bytes, at least one text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + size, side="right")))
        yield low, high
        low = high
