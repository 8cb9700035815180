"""Intermediate tables in the folder that the cluster shares, and this package in its workers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of a session, wherever the driver found it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="pagewright-code-")  # of the driver, which hands the archive to the workers
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, "pagewright_package.zip")
    with zipfile.ZipFile(archive, "w") as bundle:
        for place, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(place, name)
                    bundle.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one process on one machine may do without and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    if "root" not in _OWN:
        _OWN["root"] = "file://" + tempfile.mkdtemp(prefix="pagewright-")
    return _OWN["root"]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is already gone at exit
        pass


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder, once, and read it back: lineage ends there. Removed when the driver exits."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/pagewright/step-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
