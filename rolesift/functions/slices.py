"""Arrow batches turned into Python values a slice at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

# Python values take many times the room of the Arrow bytes they are made of
SLICE_BYTES = 1 << 20


def slices(columns: tuple[pa.Array, ...], most: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, ...]]:
    """A batch in halves until each has at most ``most`` bytes or one row."""
    n = len(columns[0])
    if n < 2 or sum(c.nbytes for c in columns) <= most:
        yield columns
        return
    for start, length in ((0, n // 2), (n // 2, n - n // 2)):
        yield from slices(tuple(c.slice(start, length) for c in columns), most)


def in_slices(batches: Iterator, make: Callable[..., list], kind: pa.DataType) -> Iterator[pa.Array]:
    """``make`` of the lists of each slice, given back before the next slice is read; where all is null nothing is made."""
    for batch in batches:
        for columns in slices(batch if isinstance(batch, tuple) else (batch,)):
            if columns[0].null_count == len(columns[0]):
                yield pa.nulls(len(columns[0]), kind)
            else:
                yield pa.array(make(*(c.to_pylist() for c in columns)), kind)
