"""Helpers shared by the training-data operators: shared storage, loading, held-out splits, ranks."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space (Java regex).
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir; in local mode without it, a folder under /tmp."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by driver and executors")
    if not _OWN:
        _OWN.append(f"/tmp/latticework-{uuid.uuid4().hex}")
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


_OWN: list[str] = []


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors.

    rows: rows of a file at most. Parquet closes no row group before 100 rows, and a reader decodes one at a time, so
    rows of several MB need files of few.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/latticework-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", maxRecordsPerFile=rows or 0).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._latticework_path = path
    return out


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Arrow batches of jobs that run inside have `size` bytes at most, or one row: for tables with rows of several MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a materialized frame."""
    sc = df.sparkSession.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(df._latticework_path)
    return int(p.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(p).getLength())


def release(*frames: DataFrame) -> None:
    """Delete the files behind materialized frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_latticework_path", None)
        if path:
            spark = df.sparkSession
            jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def give_back() -> None:
    """Return the memory that a finished fit freed to the system; a C library without malloc_trim keeps its part."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def slices(batch: pa.RecordBatch, column: int, max_rows: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice has max_rows rows at most and, unless it is one row, max_bytes of the column."""
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, at = np.concatenate(([0], np.cumsum(length))), 0
    while at < batch.num_rows:
        end = int(np.searchsorted(upto, upto[at] + max_bytes, side="right")) - 1
        end = min(max(end, at + 1), at + max_rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def remainder(id_col: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null ids have a null remainder."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % modulus


def ranked(df: DataFrame, key: str, out: str) -> DataFrame:
    """Add out = 0-based rank of key (ascending, nulls last) without moving all rows to one task.

    Range-partitions by key, numbers each partition, then adds the sizes of the partitions before it;
    the driver sees one count per partition.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = materialize(
        df.repartitionByRange(n, F.col(key).asc_nulls_last())
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(F.col(key).asc_nulls_last())))
    )
    before, base = 0, {}
    for r in sorted(parts.groupBy("_part").count().collect()):
        base[r["_part"]] = before
        before += r["count"]
    shift = F.create_map(*[F.lit(x) for kv in base.items() for x in kv]) if base else None
    first = F.element_at(shift, F.col("_part")) if base else F.lit(0)
    return parts.withColumn(out, (F.col("_row") - 1 + first).cast("long")).drop("_part", "_row")


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """At most per_class training rows of each class (0 and 1) as _id, _text, _y, and how many there are of either.

    Training rows are the documents of docs with a label whose crc32(id) mod 4 is not 2; both numbers count these, each
    id once. The sample takes the first by a hash of the id. An id with contradicting labels has the larger one; rows
    that repeat an id count as one, the first by text. Null ids and labels other than 0 and 1 are left out.
    """
    lab = (
        labels.select(F.col(id_col).cast("long").alias("_id"), F.col(target).cast("int").alias("_y"))
        .where(F.col("_y").isin(0, 1) & (remainder("_id", 4) != 2))
        .groupBy("_id").agg(F.max("_y").alias("_y"))
    )
    known = materialize(docs.select(F.col(id_col).cast("long").alias("_id")).where(remainder("_id", 4) != 2).join(lab, "_id").groupBy("_id").agg(F.max("_y").alias("_y")))
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    ids = None
    for y in (0, 1):
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # the sample has 2 * per_class rows at most
    return texts.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_y").alias("_y")), counts
