"""Groups of a sorted partition, one at a time, for functions given to mapInPandas or mapInArrow."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) for runs of equal leading ``keys`` columns; a run may span batches and only one is held."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*[column.to_pylist() for column in batch.columns]):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows
