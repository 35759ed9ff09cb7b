"""Vectors out of a table: which rows take part, in Arrow batches, with keys that tell different vectors apart."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import small_batches


def matrix(column) -> np.ndarray:
    """Rows of a list column, all of one length and without nulls, as float64."""
    n = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(n, -1) if n else np.empty((0, 0))


def usable(column, dims: int, zeros: bool) -> np.ndarray:
    """Which rows are vectors of `dims` finite entries; zeros: whether those of nothing but 0 count."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(sizes == dims)
    values = matrix_or_nan(column.take(fits), dims)
    good = np.isfinite(values).all(1) & (zeros | (values != 0).any(1))
    return fits[good]


def matrix_or_nan(column, dims: int) -> np.ndarray:
    flat = column.flatten().cast("float64")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)  # nulls become NaN


def common_length(table: DataFrame, id_column: str, vector: str) -> int:
    """The length that most vectors have, the longer one of two; 0 without any."""
    sizes = table.filter(F.col(id_column).isNotNull() & (F.size(vector) > 0)).groupBy(F.size(vector).alias("d")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return top[0].d if top else 0


def keyed(table: DataFrame, dims: int, id_column: str, vector: str, make, schema: str, zeros: bool = True) -> DataFrame:
    """Rows of the vectors that take part: their id as vec_id and what `make(float64 matrix)` gives as dict of columns.

    Other columns of `table` are not read, so their names can't clash.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    small_batches(table.sparkSession)
    spark_schema = _parse_datatype_string(f"vec_id long, {schema}")

    def run(batches):
        out = to_arrow_schema(spark_schema)
        for batch in batches:
            keep = usable(batch.column(1), dims, zeros)
            if not len(keep):
                continue
            cols = make(matrix(batch.column(1).take(keep)))
            arrays = [batch.column(0).take(keep), *[cols[f.name] for f in list(out)[1:]]]
            yield pa.RecordBatch.from_arrays([pa.array(a, f.type) if not isinstance(a, pa.Array) else a.cast(f.type) for a, f in zip(arrays, out, strict=True)], schema=out)

    chosen = table.filter(F.col(id_column).isNotNull() & F.col(vector).isNotNull())
    return chosen.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("v")).mapInArrow(run, spark_schema)


def lists(values: np.ndarray, kind=None):
    """A list column out of the rows of a matrix."""
    import pyarrow as pa

    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32)), pa.array(np.ascontiguousarray(values).reshape(-1), kind))


def digests(values: np.ndarray) -> list[bytes]:
    """128 bits of BLAKE2b of each row; 0 and -0 are one value."""
    plain = np.ascontiguousarray(values + 0.0 if values.dtype.kind == "f" else values)
    return [hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in plain]
