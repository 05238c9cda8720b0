"""Helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, StructField, StructType

from tapeloom.sources.sinks import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder_is(id_col: str | Column, modulus: int, value: int) -> Column:
    """Whether crc32 of the id as text leaves ``value``; false for a null id."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(column.cast("string")) % modulus == value, F.lit(False))


def raw(text_col: str) -> Column:
    """The whole text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def schema(*fields: tuple[str, DataType]) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields])


def portions(batches: Iterator[pa.RecordBatch], column: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes of a text column, one row at least.

    What a task holds as Python objects then depends on its longest text, not on the number of long ones.
    """
    for batch in batches:
        if not batch.num_rows:
            yield batch
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def per_row(
    df: DataFrame,
    text_col: str,
    carry: list[str],
    make: Callable[[], Callable[[str], tuple]],
    outputs: list[tuple[str, DataType]],
    as_bytes: bool = False,
) -> DataFrame:
    """Carried columns beside ``make()(text)``, one output row per input row, without a shuffle.

    ``make`` runs once per task, so what it builds (automata, memo tables, models) is shared by all
    rows of the task. A null text is passed as an empty one. Only ``carry`` and ``text_col`` are
    read, so further input columns cannot clash with the outputs.
    """
    ship_package(df.sparkSession)
    text = raw(text_col) if as_bytes else F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = df.select(*carry, text.alias("__text"))
    out = StructType([source.schema[c] for c in carry] + [StructField(n, t, True) for n, t in outputs])
    width = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        score = make()
        for batch in portions(batches, width):
            rows = [score(t) for t in batch.column(width).to_pylist()]
            columns = list(zip(*rows)) if rows else [[] for _ in outputs]
            arrays = [batch.column(i).cast(arrow.field(i).type) for i in range(width)]
            arrays += [pa.array(list(c), type=arrow.field(width + i).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return source.mapInArrow(run, out)


class Memo(dict):
    """A memo of ``fill(key)`` that starts afresh at ``size`` entries, so memory stays bounded."""

    def __init__(self, fill: Callable, size: int = 400_000):
        super().__init__()
        self.fill, self.size = fill, size

    def __missing__(self, key):
        if len(self) >= self.size:
            self.clear()
        value = self[key] = self.fill(key)
        return value
