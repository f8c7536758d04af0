"""Fixed-size count tables summed over a whole corpus: one table per task, added up slice by slice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm import kernel as K

SLICES = 256
#: Rows of a count table on its way: slice -1 is left to the caller.
COUNT_SCHEMA = "slice int, counts binary"
_COUNT = pa.schema([("slice", pa.int32()), ("counts", pa.binary())])


def sliced(table: np.ndarray) -> pa.RecordBatch:
    """A count table (int64, any shape whose last axis divides by SLICES) as one row per slice."""
    parts = np.split(table.astype(np.int64), SLICES, axis=-1)
    return K.batch_of(_COUNT, {"slice": list(range(SLICES)), "counts": [K.pack(p.reshape(-1)) for p in parts]})


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices added up as they stream in; a task holds the slices of its partition, however many tables there are."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, b in zip(K.column(batch, "slice").to_pylist(), K.column(batch, "counts"), strict=True):
            part = K.unpack(b.as_py(), np.int64)
            total[i] = total[i] + part if i in total else part
    if total:
        yield K.batch_of(_COUNT, {"slice": list(total), "counts": [K.pack(t) for t in total.values()]})


def gathered(rows: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of the tables of all tasks; its size is fixed by `shape`, whatever the corpus."""
    dealt = rows.select("slice", "counts").repartition(SLICES // 8, "slice")
    parts = {r["slice"]: K.unpack(bytes(r["counts"]), np.int64) for r in dealt.mapInArrow(_sum, COUNT_SCHEMA).collect()}
    own = (*shape[:-1], shape[-1] // SLICES)
    empty = np.zeros(own, dtype=np.int64)
    return np.concatenate([parts[i].reshape(own) if i in parts else empty for i in range(SLICES)], axis=-1)
