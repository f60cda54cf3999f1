"""What the Arrow functions of this subpackage share."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle


def ship(module: str) -> None:
    """Let a module's functions travel to the executors with their code, and this module's with them."""
    for name in (module, __name__):
        cloudpickle.register_pickle_by_value(sys.modules[name])


def pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut by their rows' mean size so that one holds about so many bytes, a row at least."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
