"""Tables written in the shared folder, to cut lineage where a plan must not be computed twice; spreading of small inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER = "lorewright-scratch"
_LOCAL: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where none is set, a temporary one in local mode and an error on a
    cluster, whose executors could not read each other's disks."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "root" not in _LOCAL:
        _LOCAL["root"] = "file://" + tempfile.mkdtemp(prefix="lorewright-")
    return _LOCAL["root"]


def own(spark: SparkSession) -> str:
    """This application's part of the folder."""
    return f"{root(spark)}/{FOLDER}/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = f"{own(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application wrote here. Results that were not stored yet may still read them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(own(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """A table read from fewer files than there are cores, spread over the cores before work in Python; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
