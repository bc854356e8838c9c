"""Groups read from a stream of Arrow batches sorted by their keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def changes(batch: pa.RecordBatch | pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Rows at which any of ``keys`` differs from the row before; the first row is one."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in keys:
        column = batch.column(k)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if len(column) > 1:
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], least: int = 1 << 14) -> Iterator[pa.Table]:
    """Tables of complete groups, of ``least`` rows or a little more, from batches sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = int(changes(table, keys)[-1])
        if last:
            yield table.slice(0, last)
        held, count = table.slice(last).to_batches(), table.num_rows - last
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
