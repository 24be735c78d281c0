"""Shared plumbing: input columns, shared storage and Arrow mapping."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_COLUMNS = ("doc_id", "text")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` only, so that other columns cannot clash; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset and Spark runs in local mode, one is made and set; on a
    cluster an unset folder is an error, for a machine's own disk would not do.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="foliospark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: what is lost with an executor is read again, not computed again.
    """
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(spark: SparkSession, *stored: DataFrame) -> None:
    """Deletes what ``materialize`` wrote, once nothing that is still to run reads it."""
    for df in stored:
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Seconds between two times that a worker gives free memory back.
TRIM_SECONDS = 2.0
#: What a worker process keeps from task to task, by owner; Spark gives a worker's next task to any operator.
KEPT: dict[str, dict] = {}


_trimmed = [0.0]


def release(but: str = "") -> None:
    """Forgets what other operators have kept in this worker, and gives free memory back now and then.

    Workers live on from stage to stage; memory that one stage's arrays left free
    would otherwise count beside what the next one needs.
    """
    for owner in [k for k in KEPT if k != but]:
        KEPT.pop(owner).clear()
    if time.monotonic() - _trimmed[0] > TRIM_SECONDS:
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            getattr(ctypes.CDLL(None), "malloc_trim", int)(0)
        _trimmed[0] = time.monotonic()


#: Bytes of an Arrow batch at most, but for single rows; Spark's own bound is 64 MB, held by the JVM and the worker of every task.
ARROW_BYTES = 12 << 20


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, most_bytes: int = 4 << 20, keeps: str = "") -> DataFrame:
    """``fn`` on slices of each Arrow batch of about ``most_bytes``, so that what it makes of them stays small.

    keeps: the owner in KEPT that ``fn`` uses.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keeps)
        for batch in batches:
            n = batch.num_rows
            step = max(1, n * most_bytes // max(1, batch.nbytes))
            for at in range(0, n, step):
                out = fn(batch.slice(at, step))
                if out is not None:
                    yield out

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    out = df.mapInArrow(run, schema)
    out.mapped = df, run
    return out


def map_further(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` on each batch that ``map_batches`` makes for ``df``, in the same worker; on any other ``df`` as ``map_batches``.

    One map behind the other would take two workers for each task, and all live on to the end of the application.
    """
    if not hasattr(df, "mapped"):
        return map_batches(df, fn, schema)
    source, run = df.mapped
    return source.mapInArrow(lambda batches: map(fn, run(batches)), schema)


#: Bits of a filter of keys: 8 MB, however many the keys are.
FILTER_BITS = 1 << 26


def maybe_in(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` may be in ``keys`` (one long column): all that are, and few others while keys are fewer than FILTER_BITS.

    Spares the shuffle of rows that a join with ``keys`` would drop. What is
    broadcast is a bitmap of FILTER_BITS at most, in pieces of 4 KB.
    """
    name = keys.columns[0]

    def place(c: str) -> Column:
        return F.pmod(F.col(c), F.lit(FILTER_BITS)) + 1

    pieces = keys.where(F.col(name).isNotNull()).groupBy(F.bitmap_bucket_number(place(name)).alias("_piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(name))).alias("_bits"))
    # the byte of the key's bit, shifted so that this bit is the last
    byte = "cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int)"
    found = rows.join(F.broadcast(pieces), F.bitmap_bucket_number(place(key)) == F.col("_piece")).withColumn("_bit", F.bitmap_bit_position(place(key)))
    return found.where(f"shiftright({byte}, cast(_bit % 8 as int)) % 2 = 1").select(*rows.columns)
