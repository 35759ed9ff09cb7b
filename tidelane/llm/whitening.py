"""Whitening of embeddings: exact sums give the mean, a second pass the covariance, its eigenvectors a projection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import durable
from tidelane.llm.vectors import common_length, digests, keyed, lists

#: Numbers of an entry: `SCALE` steps a unit, `SHIFT` added. Entries beyond `EDGE` steps count as that many.
SCALE, SHIFT, EDGE = 64, 1_000_000, float(1 << 52)
#: Levels in which partial results are merged.
DEPTH = 2


def stepped(values: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(values * SCALE, -EDGE, EDGE)).astype(np.int64) + SHIFT


def partial_sums(batches, dims: int):
    """One (n, sums as text) row of a task. Sums of up to 1,000 entries fit a long; the totals are whole numbers of any size."""
    import pyarrow as pa

    n, sums = 0, [0] * dims
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            x = matrix_of_numbers(batch.column("x").slice(a, 1000), dims)
            n += len(x)
            sums = [s + int(t) for s, t in zip(sums, x.sum(0), strict=True)]
    yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "sums": pa.array([[str(s) for s in sums]], pa.list_(pa.string()))})


def matrix_of_numbers(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def outer_products(batches, of, size: int):
    """One row of a task: the sum of outer products of what `of(matrix of x)` gives, by GEMM, as bytes."""
    import pyarrow as pa

    total = np.zeros((size, size))
    for batch in batches:
        rows = of(batch.column("x"))
        total += rows.T @ rows
    yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})


def merged(fit: DataFrame, of, size: int) -> np.ndarray:
    """Sum over all of `fit` of the outer products, merged in a tree: no task or driver takes all partial results."""
    parts = fit.mapInArrow(lambda batches: outer_products(batches, of, size), "part binary")
    zero = np.zeros((size, size))
    return parts.rdd.treeAggregate(zero, lambda acc, row: acc + np.frombuffer(row.part).reshape(size, size), lambda a, b: a + b, DEPTH)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """sum over the dimensions of (n * x - S)^2 for each row, in whole numbers; null beyond a long."""
    most = max((abs(n * int(x[:, j].max()) - s) for j, s in enumerate(sums)), default=0)
    most = max(most, max((abs(n * int(x[:, j].min()) - s) for j, s in enumerate(sums)), default=0))
    if most**2 * len(sums) < 1 << 62 and n * int(np.abs(x).max()) < 1 << 62:
        return ((n * x - np.asarray(sums, dtype=np.int64)) ** 2).sum(1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whitening(table: DataFrame, components: int = 16, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row and component.

    The fit list is each different vector of whole numbers once; its sums are exact, the second pass adds outer products of
    centred rows, and a third measures how far the covariance of the result is from the identity. A row has as many
    components as its vectors have entries, `components` at most. A component without variance (fewer vectors than entries,
    or constant ones) can't be scaled: its whitened value is null, and it isn't part of identity_error.

    Rows without an id, null and empty vectors, those with null or non-finite entries, and vectors of another length than
    the most common one are dropped. Repeated rows give rows each and count once in the fit. Entries beyond 2^46 count as
    2^46; deviation is null beyond a long. Other columns are ignored. An empty table gives an empty result.
    """
    import pyarrow as pa

    spark = table.sparkSession
    dims = common_length(table, id_column, vector)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dims:
        return spark.createDataFrame([], schema)
    rows = keyed(table, dims, id_column, vector, lambda v: {"x": lists(stepped(v))}, "x array<long>")
    unique = keyed(table, dims, id_column, vector, lambda v: {"key": digests(stepped(v)), "x": lists(stepped(v))}, "key binary, x array<long>")
    fit = durable(unique.groupBy("key").agg(F.any_value("x").alias("x")).select("x"))

    whole = fit.mapInArrow(lambda batches: partial_sums(batches, dims), "n long, sums array<string>")
    add = lambda acc, row: (acc[0] + row[0], [a + int(b) for a, b in zip(acc[1], row[1], strict=True)])
    n, sums = whole.rdd.treeAggregate((0, [0] * dims), add, add, DEPTH)
    if not n:
        return spark.createDataFrame([], schema)
    mean = np.asarray([s / n for s in sums])  # each the nearest double

    def centred(column) -> np.ndarray:
        return matrix_of_numbers(column, dims) - mean

    covariance = merged(fit, centred, dims) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    count = min(components, dims)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    trace = float(np.trace(covariance))
    real = values > max(trace, 0.0) * dims * np.finfo(float).eps
    scale = np.where(real, 1 / np.sqrt(np.where(real, values, 1.0)), 0.0)
    projection = vectors * scale
    explained = np.where(real, values, 0.0) / trace if trace > 0 else np.zeros(count)
    spread = merged(fit, lambda column: centred(column) @ projection, count) / n
    error = float(np.abs(spread - np.eye(count))[np.ix_(real, real)].max()) if real.any() else 0.0
    shared = spark.sparkContext.broadcast((mean, projection))  # dims x components numbers

    def run(batches):
        centre, matrix_ = shared.value
        for batch in batches:
            x = matrix_of_numbers(batch.column("x"), dims)
            if not len(x):
                continue
            white = ((x - centre) @ matrix_).reshape(-1)
            m = len(x)
            yield pa.RecordBatch.from_pydict({
                "vec_id": pa.array(np.repeat(batch.column("vec_id").to_numpy(), count), pa.int64()),
                "component": pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * count, n, dtype=np.int64)),
                "deviation": pa.array([d for d in deviations(x, n, sums) for _ in range(count)], pa.int64()),
                "whitened": pa.array(white, mask=np.tile(~real, m)),
                "explained": pa.array(np.tile(explained, m)),
                "identity_error": pa.array(np.full(m * count, error)),
            })

    return rows.mapInArrow(run, schema)
