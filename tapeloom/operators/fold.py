"""Ordered folds per key, for rules whose next decision needs their previous ones.

Rows are hash-partitioned and sorted by Spark; Python sees one Arrow batch at a time and
carries only a small state from row to row, so a long key is streamed and never collected.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType, DataType


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    inputs: Sequence[str],
    start: Callable[[], object],
    step: Callable[..., tuple[object, object]],
    out: str,
    out_type: DataType,
) -> DataFrame:
    """Adds ``out``: ``step(state, *inputs) -> (state, value)`` in key order.

    ``start()`` makes the state of a new key.
    """
    keys, order, inputs = list(keys), list(order), list(inputs)
    schema = StructType(df.schema.fields + [StructField(out, out_type, True)])

    def run(batches):
        current, state = None, None
        for pdf in batches:
            values = []
            key_rows = list(zip(*(pdf[k] for k in keys)))
            for key, row in zip(key_rows, zip(*(pdf[c] for c in inputs))):
                if key != current:
                    current, state = key, start()
                state, value = step(state, *row)
                values.append(value)
            yield pdf.assign(**{out: pd.Series(values, index=pdf.index, dtype=object)})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
