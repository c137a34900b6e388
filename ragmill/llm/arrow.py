"""Small helpers for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def over_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: str) -> DataFrame:
    """``mapInArrow`` with one worker object per task; ``make`` runs on the executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return df.mapInArrow(run, schema)


def int_lists(parts: list[bytes]) -> pa.ListArray:
    """A list<int32> column from the lists' raw little-endian bytes."""
    lengths = np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts)) // 4
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    values = np.frombuffer(b"".join(parts), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
