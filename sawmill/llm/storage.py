"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where it is unset, a local master (as in tests) gets a folder of this machine; on a cluster
    executors would write to disks of their own, so that raises."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sawmill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The rows written as Parquet under the shared folder and read again: a lost executor costs no recomputation.  Every
    task of the last stage writes a file; adaptive execution sizes those that read a shuffle."""
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/sawmill/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """Rows that are used more than once within an operator, on the executors' disks; what a lost executor had is computed
    again from the tables before it.  The operator lets go of them with unpersist()."""
    return df.persist(StorageLevel.DISK_ONLY)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that written() made, once nothing reads them any more."""
    for df in tables:
        _delete(df)


def _delete(df: DataFrame) -> None:
    spark = df.sparkSession
    jvm = spark._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
