"""Shared scratch space: where iterative operators cut lineage.

On a cluster the folder is the one named by ``spark.checkpoint.dir``; only where that setting is
absent, and Spark runs on one machine (tests, a laptop), is a folder made here, under the system's
temporary directory; a cluster without the setting is an error.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in its terms."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any file system, folders included; one that is there is replaced."""
    fs, target = file_system(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, source = file_system(spark, path)
    file = fs.open(source)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
    file.close()
    return text


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = file_system(spark, path)
    return fs.exists(target)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below a path, sorted."""
    fs, target = file_system(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(target) if f.isDirectory()) if fs.exists(target) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, target = file_system(spark, path)
    fs.delete(target, True)


def copy(spark: SparkSession, source: str, target: str) -> None:
    """A file or folder to a path that isn't there yet."""
    (fs, old), (other, new) = file_system(spark, source), file_system(spark, target)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    if not spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, old, other, new, False, conf):
        raise OSError(f"can't copy {source}")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediates; also registers it as checkpoint folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.applicationId not in _own:
        if sc.getCheckpointDir():
            return sc.getCheckpointDir().rstrip("/")
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="tallyloom-")
        sc.setCheckpointDir(_own[sc.applicationId])
    return _own[sc.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/tallyloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage, survives the loss of executors and gives the planner the true size of the
    data, so that joins with it are broadcast only when it is in fact small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep_scratch(spark: SparkSession) -> None:
    """Delete this application's written intermediates (results read from them become invalid)."""
    path = f"{scratch_root(spark)}/tallyloom/{spark.sparkContext.applicationId}"
    delete(spark, path)
    if spark.sparkContext.applicationId in _own:
        shutil.rmtree(_own.pop(spark.sparkContext.applicationId), ignore_errors=True)
