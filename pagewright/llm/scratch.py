"""Shared scratch storage and worker set-up for the training-data operators.

Intermediate tables that are read more than once, or whose row order fixes an
integer name, are written as Parquet under ``spark.checkpoint.dir`` (a folder
that every executor sees) and read back. That cuts lineage without a local
checkpoint, so losing an executor costs a task and not the job.
"""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; one process on one machine may do without and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    if "root" not in _OWN:
        _OWN["root"] = "file://" + tempfile.mkdtemp(prefix="pagewright-")
    return _OWN["root"]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is already gone at exit
        pass


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared root, removed when the driver exits."""
    path = f"{shared_root(spark)}/pagewright/{label}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _few(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)


def spread(df: DataFrame) -> DataFrame:
    """``df``, a table of ids, in few partitions, dealt out anew: what made it keeps all its tasks."""
    return df.repartition(_few(df.sparkSession))


def stored(df: DataFrame, label: str, few: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    ``few`` writes an eighth of the shuffle partitions, and a file for each core
    at least, for tables of ids that rounds write again and again. Their rows are
    a small part of the texts', so the tasks stay smaller than those of a text
    stage; many small files cost more than they hold, and on local file systems
    a process each to set permissions.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if few:
        df = df.coalesce(_few(spark))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _field(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """Each row of ``docs`` as one struct ``row`` beside the columns ``keys``, so that no name in it can clash."""
    return docs.select(F.struct(*[F.col(_field(c)) for c in docs.columns]).alias("row"), *[key.alias(name) for name, key in keys.items()])


def unpacked(rows: DataFrame, **more: Column) -> DataFrame:
    """The columns of ``row``, then ``more``, which take the place of columns of the same name."""
    names = [f.name for f in rows.schema["row"].dataType.fields]
    return rows.select(*[F.col("row").getField(n).alias(n) for n in names if n not in more], *[c.alias(n) for n, c in more.items()])


#: Rows of an Arrow batch; texts can be long, and a worker holds a batch or two.
BATCH_ROWS = "1000"


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver found it.

    Where the session has Spark's default for rows in an Arrow batch, which suits
    numbers rather than texts, it is lowered.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if context.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="pagewright-ship-"), "pagewright_code.zip")
    with zipfile.ZipFile(archive, "w") as bundle:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    bundle.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
