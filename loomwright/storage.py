"""The folder that all executors share: tables that are written once and read many times, and cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session without that setting gets a temporary folder of its own, which goes when the process ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loomwright-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Everything that this process writes there is in one folder.
_RUN = uuid.uuid4().hex


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/loomwright/{_RUN}/{tag}-{uuid.uuid4().hex}"


def hadoop(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """Spark's own file system for a path, and the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    store, at = hadoop(spark, path)
    store.delete(at, True)


def cleanup(spark: SparkSession) -> None:
    """Delete what this process has written to the shared folder. Results that haven't been saved elsewhere go with it."""
    delete(spark, f"{shared_dir(spark)}/loomwright/{_RUN}")


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` and read it back; lost executors don't take it along."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of the engine's own (few), or none if there is no such folder."""
    store, at = hadoop(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(at)) if store.exists(at) else []


def publish(spark: SparkSession, temporary: str, final: str) -> bool:
    """Give a finished file or folder its name in one step; false, and nothing done, if the name is taken."""
    store, source = hadoop(spark, temporary)
    target = hadoop(spark, final)[1]
    store.mkdirs(target.getParent())
    return not store.exists(target) and bool(store.rename(source, target))
