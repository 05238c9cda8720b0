"""Keyed state in hash buckets: an upsert rewrites the buckets of its keys and no others.

A table is a folder of bucket folders and a list of versions. A version names one folder for each bucket.
An upsert reads the buckets that its rows fall into, writes them anew beside the old ones and then adds
the next version in one step, so a reader sees the state before or after it, never a mix, and two writers
that started from the same version cannot both succeed. Work grows with the rows of the touched buckets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeloom.operators.keyed import first_per_key, upsert_last_wins

BUCKETS = 256


class VersionConflict(RuntimeError):
    """Another writer has added the version first; nothing was changed."""


def _fs(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def newest_version(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and content of the newest version; 0 and an empty table before the first one."""
    fs, path = _fs(spark, f"{root}/versions")
    if not fs.exists(path):
        return 0, {"schema": None, "buckets": None, "folders": {}}
    number = max((int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()), default=0)
    if not number:
        return 0, {"schema": None, "buckets": None, "folders": {}}
    text = spark.read.text(f"{root}/versions/{number:010d}", wholetext=True).first()["value"]
    return number, json.loads(text)


def add_version(spark: SparkSession, root: str, number: int, content: dict) -> None:
    """Adds version ``number`` in one step: the file is complete before it gets its name."""
    fs, folder = _fs(spark, f"{root}/versions")
    fs.mkdirs(folder)
    _, draft = _fs(spark, f"{root}/versions/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    _, name = _fs(spark, f"{root}/versions/{number:010d}")
    if fs.exists(name) or not fs.rename(draft, name):
        fs.delete(draft, False)
        raise VersionConflict(f"version {number} of {root} is there already")


def read_state(spark: SparkSession, root: str, only: Sequence[int] | None = None) -> DataFrame | None:
    """The newest state, or its buckets ``only``; None before the first version."""
    _, content = newest_version(spark, root)
    return _read(spark, content, only)


def _read(spark: SparkSession, content: dict, only: Sequence[int] | None) -> DataFrame | None:
    if content["schema"] is None:
        return None
    folders = [f for b, f in content["folders"].items() if only is None or int(b) in set(only)]
    reader = spark.read.schema(content["schema"])
    return reader.parquet(*folders) if folders else spark.createDataFrame([], content["schema"])


def _change(spark: SparkSession, new: DataFrame, root: str, keys: Sequence[str], merge: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int) -> None:
    number, content = newest_version(spark, root)
    buckets = content["buckets"] or buckets
    at = bucket_of(keys, buckets)
    touched = sorted(r["b"] for r in new.select(at.alias("b")).distinct().collect())  # ``buckets`` at most
    if not touched:
        return
    merged = merge(_read(spark, content, touched), new)
    folder = f"{root}/data/{uuid.uuid4().hex}"
    merged.withColumn("_bucket", at).repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(folder)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in merged.schema)
    folders = {**content["folders"], **{str(b): f"{folder}/_bucket={b}" for b in touched}}
    add_version(spark, root, number + 1, {"schema": fields, "buckets": buckets, "folders": folders})


def upsert_state(new: DataFrame, root: str, keys: Sequence[str], order: Sequence[str], update: Sequence[str] | None = None, buckets: int = BUCKETS) -> None:
    """The last new row of a key replaces the stored one; with ``update`` in those columns only."""
    def merge(stored: DataFrame | None, rows: DataFrame) -> DataFrame:
        return upsert_last_wins(rows.limit(0) if stored is None else stored, rows, keys, order, update)

    _change(new.sparkSession, new, root, keys, merge, buckets)


def insert_state(new: DataFrame, root: str, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS) -> None:
    """The first row of a key stays, whether it was stored before or comes first in ``new``."""
    def merge(stored: DataFrame | None, rows: DataFrame) -> DataFrame:
        first = first_per_key(rows, keys, order)
        return first if stored is None else stored.unionByName(first.join(stored.select(*keys), list(keys), "left_anti"))

    _change(new.sparkSession, new, root, keys, merge, buckets)


def expire(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Drops all versions but the newest ``keep`` and the data that only they name."""
    number, _ = newest_version(spark, root)
    fs, path = _fs(spark, f"{root}/versions")
    if not fs.exists(path):
        return
    stays = set()
    for s in list(fs.listStatus(path)):
        name = s.getPath().getName()
        if name.isdigit() and int(name) > number - keep:
            text = spark.read.text(f"{root}/versions/{name}", wholetext=True).first()["value"]
            stays |= {f.split("/data/")[1].split("/")[0] for f in json.loads(text)["folders"].values()}
        elif name.isdigit():
            fs.delete(s.getPath(), False)
    fs, data = _fs(spark, f"{root}/data")
    for s in list(fs.listStatus(data)) if fs.exists(data) else []:
        if s.getPath().getName() not in stays:
            fs.delete(s.getPath(), True)
