"""What the text operators share: bounded labelled samples, checkpoints, row keys, components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`; only where that is unset and Spark runs on this machine alone, a folder of it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _LOCAL.setdefault("folder", tempfile.mkdtemp(prefix="shared-"))
    return folder.rstrip("/")


_LOCAL: dict[str, str] = {}

#: Rows of an Arrow batch where the session doesn't say: texts and sets are large, and Spark's 10,000 of them take 100 MB or more a task.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches to BATCH_ROWS rows, unless the user has set a bound."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


_WRITTEN: dict[str, SparkSession] = {}


def durable(df: DataFrame) -> DataFrame:
    """`df` written as a table to the shared folder, so that a lost executor costs no recomputation.

    Shuffle files of what led to it are of no more use, but Spark deletes them only once the driver has collected its
    garbage, hence that call. The table goes with `discard`; what a returned frame still reads stays until the driver
    ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN[path] = spark
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables that `durable` wrote and nothing reads any more."""
    for df in frames:
        path = getattr(df, "_table", None)
        if path and _WRITTEN.pop(path, None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


@atexit.register
def _discard_all() -> None:
    for path, spark in list(_WRITTEN.items()):
        with contextlib.suppress(Exception):  # the driver may have stopped Spark already
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def text_key() -> Column:
    """Tells rows of one doc_id with different texts apart; null texts have a key of their own."""
    return F.xxhash64(F.col("text").isNull(), F.col("text"))


def held_out(folds: int, fold: int) -> Column:
    """Whether crc32(doc_id as text) mod `folds` is `fold`; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, max_rows: int, max_bytes: int) -> list[tuple[str, int]]:
    """(text, label) of labelled documents outside the held-out fold, at most `max_rows` and `max_bytes` in all.

    The rows with the smallest hash of doc_id are taken, half of `max_rows` and of `max_bytes` for each label at most.
    Labels of one doc_id count once (the largest); null labels, ids and texts are left out. The bound on both figures
    is what makes it safe to bring these texts to the driver.
    """
    ids = labels.select("doc_id", F.col(label).alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).filter(~held_out(folds, fold))
    ids = ids.groupBy("doc_id").agg(F.max("y").alias("y"))
    docs = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    got = []
    for y in (0, 1):
        few = ids.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2)
        size = docs.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("b"), F.min(F.xxhash64("doc_id")).alias("h"))
        left, chosen = max_bytes // 2, []
        for r in size.orderBy("h", "doc_id").collect():
            if r.b <= left:
                left -= r.b
                chosen.append((r.doc_id,))
        if chosen:
            want = docs.sparkSession.createDataFrame(chosen, "doc_id long")
            got += [(r.text, y) for r in docs.join(F.broadcast(want), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").collect()]
    return got


def label_counts(labels: DataFrame, label: str, folds: int, fold: int) -> tuple[int, int]:
    """How many doc_ids outside the held-out fold have label 0, and how many 1."""
    ids = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).filter(~held_out(folds, fold))
    row = ids.groupBy("doc_id").agg(F.max(label).alias("y")).agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).head()
    return row[0], row[1]


def rows_to_arrow(docs: DataFrame, fn, schema: str, *more: str) -> DataFrame:
    """`fn(list of texts) -> dict of columns` over every document; doc_id and the columns `more` go along."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    small_batches(docs.sparkSession)
    spark_schema = _parse_datatype_string(schema)

    def run(batches):
        out = to_arrow_schema(spark_schema)
        for batch in batches:
            for part in pieces(batch):
                cols = fn(part.column("text").to_pylist())
                arrays = [part.column(f.name) if f.name in ("doc_id", *more) else pa.array(cols[f.name], f.type) for f in out]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, out, strict=True)], schema=out)

    return docs.select("doc_id", *more, "text").mapInArrow(run, spark_schema)


def pieces(batch, most: int = 256_000, column: str = "text"):
    """Slices of an Arrow batch with about `most` bytes in `column` each (a longer value stands alone)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def unused(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it (Spark compares names without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
