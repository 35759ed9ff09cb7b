"""Nearest neighbours by a permutation index: vectors as ordered nearest pivots, posted in inverted files of the pivots."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import durable
from tidelane.llm.vectors import common_length, digests, keyed, lists, matrix

#: Pivots that the index is fitted on (that many sampled vectors), and how many nearest ones stand for a vector.
PIVOTS, PREFIX = 256, 128
#: Blocks of the index; more of them once one would hold over BLOCK_ROWS vectors.
BLOCKS, BLOCK_ROWS = 64, 65_536
#: Of a block, the share that is reranked for a query, and at least how many.
RERANKED, RERANKED_LEAST = 0.05, 32
#: Parts that the queries of one vector are dealt to.
SALTS = 8


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of each row's `prefix` nearest pivots, the nearest first."""
    far = (pivots**2).sum(1)[None, :] - 2 * vectors @ pivots.T
    return np.argsort(far, axis=1, kind="stable")[:, :prefix].astype(np.int16)


class Block:
    """Vectors of a block with an inverted file for each pivot: the rows that have it among their nearest, and its place."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], pivots: np.ndarray, prefix: int):
        self.vectors, self.ids, self.pivots, self.prefix = vectors, ids, pivots, prefix
        orders = np.concatenate([nearest_pivots(vectors[a : a + 4096], pivots, prefix) for a in range(0, len(vectors), 4096)])
        by_pivot = np.argsort(orders.reshape(-1), kind="stable")
        self.rows, self.places = (by_pivot // prefix).astype(np.int32), (by_pivot % prefix).astype(np.int16)
        self.begin = np.searchsorted(orders.reshape(-1)[by_pivot], np.arange(len(pivots) + 1))

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of each row's order to a query's, less a constant; a pivot beyond the prefix stands right after it."""
        m, out = self.prefix, np.zeros(len(self.vectors), np.int32)
        for place, pivot in enumerate(order.tolist()):
            a, b = self.begin[pivot], self.begin[pivot + 1]
            places = self.places[a:b].astype(np.int32)
            out[self.rows[a:b]] += np.abs(places - place) - (m - place) - (m - places)  # instead of both being missing
        return out

    def search(self, query: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of the nearest of those with the smallest footrule, `most` at most."""
        n = len(self.vectors)
        few = min(n, max(RERANKED_LEAST, round(RERANKED * n), most))
        away = self.footrule(order)
        rows = np.argpartition(away, few - 1)[:few] if few < n else np.arange(n)
        far = np.sqrt(((self.vectors[rows] - query) ** 2).sum(1))
        first = np.asarray([self.ids[r][0] for r in rows.tolist()])
        best = np.lexsort((first, far))[:most]
        return rows[best], far[best]


def searched(batches, pivots: np.ndarray, prefix: int, most: int, out):
    """Batches of (key of a query, distance, ids of a vector), out of rows sorted by block, the vectors before the queries."""
    import pyarrow as pa

    now, vectors, ids, block = None, [], [], None
    for batch in batches:
        numbers = batch.column("block").to_numpy()
        kinds = batch.column("query").to_numpy(zero_copy_only=False).astype(np.int8)
        edges = [0, *(np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(numbers)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if numbers[a] != now:
                now, vectors, ids, block = numbers[a], [], [], None
            if not kinds[a]:
                vectors.append(matrix(part.column("v")))
                ids += part.column("ids").to_pylist()
                continue
            if block is None and vectors:
                block, vectors = Block(np.concatenate(vectors), ids, pivots, prefix), []
            if block is None:  # nothing to find here
                continue
            wanted = matrix(part.column("v"))
            keys, far, found = [], [], []
            for key, query, order in zip(part.column("key").to_pylist(), wanted, nearest_pivots(wanted, pivots, prefix), strict=True):
                rows, distances = block.search(query, order, most)
                keys += [key] * len(rows)
                far += distances.tolist()
                found += [block.ids[r] for r in rows.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, out.field(0).type), pa.array(far, out.field(1).type), pa.array(found, out.field(2).type)], schema=out)


def neighbours(table: DataFrame, every: int = 100, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest rows found for each row whose id is divisible by `every`.

    score is the Euclidean distance in double precision; ties go to the smaller id; a query is never its own neighbour.
    With fewer candidates than `k`, all are found. Equal vectors are indexed and searched for once, with the k + 1
    smallest ids that have them, so copies neither crowd a block nor a task. The index is fitted on `pivots` vectors, those
    with the smallest hashes of all different ones, and holds every vector: they are dealt to blocks by hash, each with its
    own inverted files, and a query's row goes to each block, where RERANKED of the vectors (RERANKED_LEAST at least) with the
    smallest footrule distance are measured.

    Null, zero and empty vectors, those with null or non-finite entries, rows without an id, and vectors of another length
    than the most common one take no part. A repeated row counts once; other vectors under one id are rows of their own, but
    no neighbours of each other. Other columns are ignored. An empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = table.sparkSession
    entry = table.schema[vector].dataType.elementType.simpleString()
    kind = "float" if entry == "float" else "double"
    dims = common_length(table, id_column, vector)

    def make(values: np.ndarray) -> dict:
        return {"key": digests(values), "v": lists(values.astype(np.float32) if kind == "float" else values)}

    rows = keyed(table, dims, id_column, vector, make, f"key binary, v array<{kind}>", zeros=False)
    pairs = rows.groupBy("key", "vec_id").agg(F.any_value("v").alias("v"))
    first = pairs.withColumn("n", F.expr("row_number() over (partition by key order by vec_id)")).filter(F.col("n") <= k + 1)
    classes = durable(first.groupBy("key").agg(F.any_value("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    sample = classes.orderBy("key").limit(pivots).select("v").collect()  # `pivots` rows at most
    fitted = np.asarray([r.v for r in sample], dtype=np.float64).reshape(len(sample), dims)
    m = max(1, min(prefix, (len(sample) + 1) // 2))
    blocks = max(BLOCKS, -(-classes.count() // BLOCK_ROWS))

    asked = rows.filter(F.col("vec_id") % every == 0).select("key", "vec_id", "v")
    once = asked.groupBy("key").agg(F.any_value("v").alias("v"))
    everywhere = once.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("query"), "key", "v", F.lit(None).cast("array<long>").alias("ids"))
    index = classes.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("query"), "key", "v", "ids")
    schema = _parse_datatype_string("key binary, score double, ids array<long>")
    found = index.unionByName(everywhere).repartition("block").sortWithinPartitions("block", "query").mapInArrow(lambda batches: searched(batches, fitted, m, k + 1, to_arrow_schema(schema)), schema)

    nearest = found.withColumn("n", F.expr("row_number() over (partition by key order by score, ids[0])")).filter(F.col("n") <= k + 1)
    each = F.transform("ids", lambda i: F.struct(F.col("score").alias("score"), i.alias("vec_id")))
    lists_ = nearest.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list(each))).alias("best"))
    dealt = lists_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    ids = asked.select("key", F.col("vec_id").alias("query_id")).distinct().withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int"))
    own = ids.join(dealt, ["key", "salt"])
    best = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(best).alias("i", "b")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
