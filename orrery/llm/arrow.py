"""Plumbing shared by the Arrow-based operators: batches in, bounded chunks out."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 21
#: Bytes of a batch on its way to a worker and back; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(docs: DataFrame) -> DataFrame:
    """``docs``, whose session sends at most BATCH_BYTES at once to Python workers from now on.

    By rows alone, 10,000 long texts make a batch that is held several times over.
    """
    conf = docs.sparkSession.conf
    now = conf.get(BATCH_SETTING).rstrip("b")
    if now.isdigit() and int(now) > BATCH_BYTES:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return docs


def doc_columns(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string) of ``docs``; null text becomes the empty text."""
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches holding about ``most`` bytes of ``column``, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(offsets(batch.column(column)))
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop
    tidy()


def tidy() -> None:
    """Gives unused memory back to the system, as workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps its memory
        ctypes.CDLL(None).malloc_trim(0)


def offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array, as int64 and from its own slice."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows as one uint8 array, and the rows' offsets in it."""
    at = offsets(column)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blobs(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir and all executors share.

    Only a session whose executors are threads of the driver may do without one; it gets a
    temporary folder. Elsewhere the executors would not see the driver's folder, so this raises.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc._jsc.sc().getCheckpointDir().get()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="orrery-checkpoint-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


#: Folder of the tables that cut() writes inside of scratch().
_SCRATCH: ContextVar[str | None] = ContextVar("orrery_scratch", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that cut() writes meanwhile are deleted at the end; what is made from them must be written by then."""
    folder = f"{checkpoint_dir(spark)}/orrery-scratch-{uuid.uuid4().hex}"
    token = _SCRATCH.set(folder)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` as a table written to the shared checkpoint folder and read again, in folders by a column if ``by`` is given.

    It survives lost executors, and carries none of the lineage, constraints and
    orderings that a checkpointed plan keeps, which multiply in iterative joins. Tables
    written outside of scratch() stay until the job's checkpoint folder is cleared.
    """
    spark = df.sparkSession
    path = f"{_SCRATCH.get() or checkpoint_dir(spark)}/orrery-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])
