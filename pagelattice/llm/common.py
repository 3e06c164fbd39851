"""What the operators share: tables, the shared folder, sizes and small column helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words in the operators that count words: space, and tab to carriage return.
WORD_RX = r"[^ \t-\r]+"
GAP_RX = r"[ \t-\r]+"

_made: list[tuple[weakref.ref, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, else one made for a local session. On a
    cluster without that setting there is none, which is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isEmpty():
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="pagelattice-"))
            kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = kept.get()
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the interpreter ends."""
    path = f"{shared_dir(spark)}/pagelattice/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((weakref.ref(spark), path))
    return path


def scratch_paths() -> list[str]:
    """All scratch paths made so far, in order."""
    return [path for _, path in _made]


def last_scratch() -> str:
    """The path that was made last."""
    return _made[-1][1]


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more. The shuffle files of the plans that did go when the JVM collects
    their objects, which it is asked to do."""
    gc.collect()
    spark._jvm.System.gc()
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for ref, path in _made:
        spark = ref()
        jsc = getattr(getattr(spark, "sparkContext", None), "_jsc", None)
        if jsc is None:
            continue
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may have ended before the interpreter
            return


def files_for(df: DataFrame) -> int:
    """How many files df is written to at most: four for each core, or as many as the session's scans would read it in."""
    spark = df.sparkSession
    piece = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return max(4 * spark.sparkContext.defaultParallelism, -(-size_estimate(df) // piece))


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet into the shared folder and read back: its lineage ends there, and a lost executor loses
    nothing. Many small partitions are written together: each file costs a few calls, on local paths even processes."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.coalesce(files_for(df)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of the batches that go to Python: a batch of whole texts stays small however long they are.
BATCH_BYTES = 4 << 20


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow in batches of bounded bytes (the session keeps that setting), by workers that hand back what memory a
    task has used: they live on beside the next stages, which need it."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return df.mapInArrow(run, schema)


def size_estimate(df: DataFrame) -> int:
    """Bytes of what df is made from: the files' lengths, where it is files. Estimates of joins are products, and those of
    rows that the driver made are unknown; neither is of use here."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def partitions_for(df: DataFrame, each: int) -> int:
    """Partitions of about `each` bytes, as many at least as the session shuffles to."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(200_000, -(-size_estimate(df) // each)))


def let(value: Column, body) -> Column:
    """body(x) with x bound to the value, which is computed once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text, null as none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP_RX), "")
