"""Helpers for functions that run over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows, and bytes on average, of the slice of an Arrow batch that an operator works on at once.
BATCH_ROWS, BATCH_BYTES = 2000, 2_000_000


def int_lists(flat: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """A list array of the given lengths over flat int32 values."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32, copy=False)))


def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most BATCH_ROWS rows and about BATCH_BYTES, so memory does not follow the session's batch size."""
    if not b.num_rows:
        return
    rows = max(1, min(BATCH_ROWS, int(BATCH_BYTES * b.num_rows / max(b.nbytes, 1))))
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow, a slice at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                out = fn(b)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def spread(df: DataFrame, parts: int) -> DataFrame:
    """Give a CPU-bound stage at least `parts` tasks where the scan (a plan without exchanges) has fewer splits, at the price of writing its
    rows to shuffle files once; a no-op on large inputs. The rows are the same either way."""
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df
