"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode without that setting a folder under /tmp, deleted at exit."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by driver and executors")
    if not _OWN:
        _OWN.append(f"/tmp/latticework-{uuid.uuid4().hex}")
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def written(df: DataFrame, plain: bool = False) -> DataFrame:
    """df written once and read back: its plan is not run again, and lost executors cost no more than their tasks.

    plain: neither compressed nor by dictionary. Spark takes the size of the files for the size of the table, and would
    broadcast one that is small in files only; this one is as large there as in memory.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    how = {"compression": "none", "parquet.enable.dictionary": "false"} if plain else {"compression": "zstd"}
    df.write.options(**how).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
