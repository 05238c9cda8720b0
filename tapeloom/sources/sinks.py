"""Table writes. A job never reads the path it overwrites: state goes to a new version."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F


def append_facts(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_version(df: DataFrame, root: str, version: str, partition_by: list[str] | None = None) -> str:
    """Full state under ``root/version``; returns the path for the next reader."""
    path = f"{root}/version={version}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def write_report(df: DataFrame, path: str) -> None:
    """A report of a few rows as JSON lines."""
    df.write.mode("append").json(path)


def report_row(df: DataFrame, name: str) -> DataFrame:
    """A one-row report as (name, body JSON)."""
    return df.select(F.lit(name).alias("name"), F.to_json(F.struct("*")).alias("body"))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    base = Path(tempfile.mkdtemp(prefix="tapeloom-")) / "tapeloom_package"
    spark.sparkContext.addPyFile(shutil.make_archive(str(base), "zip", root.parent, root.name))
    _SHIPPED.add(app)


_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("staged tables of open scopes", default=())


def stage(df: DataFrame, name: str, outlives: bool = False, by: str | None = None) -> DataFrame:
    """Writes an intermediate table to the shared folder and returns a reader of it.

    For results that several later steps read: they are computed once, and a lost executor
    costs a re-read of files instead of the whole lineage. Inside ``staging`` the table is deleted
    when the block ends; with ``outlives`` it belongs to the block around that one. ``by`` gives
    each value of a column a folder.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    scopes = _SCOPES.get()
    if len(scopes) > outlives:
        scopes[-1 - outlives].append(path)
    if by is None:
        df.write.parquet(path)
        return df.sparkSession.read.parquet(path)
    df.repartition(by).write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # an empty table has no files to read it from


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Deletes what is staged inside it. A result that is read later must be staged with ``outlives``."""
    own: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), own))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for name in own:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="tapeloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path
