"""Whole vectors of a table as integer rows: checked, scaled and written once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tidewatch.llm.common import written

#: Integers up to this size keep sums of squares over a few thousand components exact.
LARGEST = 1 << 24


def matrix(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and rows (float64) of the vectors in an Arrow list column that have ``dim`` finite components."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a NULL becomes NaN
    rows = flat.reshape(len(at), dim)
    whole = np.isfinite(rows).all(axis=1)
    return at[whole], rows[whole]


def lists(values: np.ndarray):
    """A two-dimensional array as an Arrow list column."""
    import pyarrow as pa

    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def batch_map(df: DataFrame, rows: Callable[[Iterator], Iterator[dict]], schema: StructType, batch_rows: int | None = None) -> DataFrame:
    """mapInArrow: ``rows`` turns a task's record batches into dicts of columns.

    ``batch_rows`` bounds the rows of a batch, where rows hold whole texts."""
    if batch_rows:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    out = to_arrow_schema(schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for got in rows(batches):
            cols = [got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], f.type) for f in out]
            yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(cols, out)], schema=out)

    return df.mapInArrow(run, schema)


def integer_rows(df: DataFrame, vector: str, scale: int, shift: int, carry: Sequence[str]) -> tuple[DataFrame, int]:
    """``carry``, slot, at and x = floor(scale * component) + shift (array of longs) of each row, and their length.

    Rows are dropped whose vector is NULL, holds a NULL or non-finite component, or has another
    length than most such vectors (of lengths equally frequent, the larger). ``slot`` and ``at``
    number the rows: ``at`` from 0 within each slot. An integer beyond ``LARGEST`` (apart from
    the shift) is an error, as sums of its squares would leave the range of a long.
    """
    fields = [df.schema[c] for c in carry]
    schema = StructType([*fields, *StructType.fromDDL("size int, slot int, at long, x array<long>").fields])

    def read(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        slot, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            column = batch.column(len(carry))
            for dim in pc.list_value_length(column).drop_null().unique().to_pylist():
                at, rows = matrix(column, dim)
                x = np.floor(rows * scale)
                if x.size and np.abs(x).max() > LARGEST:
                    raise ValueError(f"a component of {vector} is beyond {LARGEST / scale} in size")
                kept = {c: batch.column(i).take(pa.array(at)) for i, c in enumerate(carry)}
                yield kept | {
                    "size": np.full(len(at), dim, np.int32), "slot": np.full(len(at), slot, np.int32),
                    "at": np.arange(seen, seen + len(at)), "x": lists(x.astype(np.int64) + shift),
                }
                seen += len(at)

    rows = written(batch_map(df.select(*carry, vector), read, schema))
    most = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    size = most["size"] if most else 0
    return rows.filter(F.col("size") == size).drop("size"), size
