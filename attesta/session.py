"""Session helpers: table access, the shared folder and worker limits."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    """A temporary folder of this process, gone when it ends."""
    path = tempfile.mkdtemp(prefix="attesta-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in storage that all executors can read.

    It lies in the one the cluster names in ``spark.checkpoint.dir``; what is in it can go when the application has
    ended. Only where none is set, as in a local test session, a temporary folder of this machine is used.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return f"{conf.rstrip('/')}/attesta-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


def materialize(df: DataFrame, name: str = "stage", compression: str = "snappy") -> DataFrame:
    """Cut the lineage of ``df`` by writing it as a parquet table in the shared folder.

    Unlike a cache it survives the loss of executors, and unlike ``checkpoint()`` what is read back
    is columnar, so later column pruning and filters still reach the scan.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slots(spark: SparkSession) -> int:
    """Tasks that can run at the same time, as far as the session knows."""
    return max(1, spark.sparkContext.defaultParallelism)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` from the driver, to be broadcast, if it has at most so many rows; else ``df`` unchanged.

    At most ``rows`` + 1 rows reach the driver, so the check itself is bounded.
    """
    found = df.limit(rows + 1).toArrow()
    if found.num_rows > rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(found, schema=df.schema))
