"""The folder that the driver and all executors share, and tables written there.

A table written to the shared folder cuts lineage: later stages read files, so the
loss of an executor never re-runs what came before.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, an own folder that goes with the process, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        atexit.register(shutil.rmtree, _OWN[key], ignore_errors=True)
    return _OWN[key]


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over tasks by its keys, before its rows are multiplied: a small file is read by one task, however much is made of it.

    The number is fixed to that of shuffles, for few bytes would be put together again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the other side of a join of multiplied rows, which are never broadcast: their size is estimated from the file that they come from."""
    return df.hint("merge")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
