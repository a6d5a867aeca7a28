"""Session helpers: shared scratch folder, materialised stages, parallelism."""

from __future__ import annotations

import tempfile
import types
import uuid
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def build(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, skew joins)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Where the setting is absent a local folder is made and set, but for local masters only (tests, one machine): on a
    cluster every executor would write to a disk of its own, so there it's an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        named = Path(tempfile.mkdtemp(prefix="tidemark-shared-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_marked: set[str] = set()


def session_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the application ends."""
    path = f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}"
    if path not in _marked:
        _marked.add(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a stage as a table in the shared folder and reads it back.

    The lineage ends there: what is read later survives the loss of any executor, and the
    stage isn't computed again by each of its readers.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, length, time of change) of a table's files, from one listing; empty where nothing is stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at)) if fs.exists(at) else []


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions in force, for operators that fix their own partition number."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def ship(module: types.ModuleType) -> None:
    """Python code of this module travels with the job, so executors needn't have the package."""
    cloudpickle.register_pickle_by_value(module)
