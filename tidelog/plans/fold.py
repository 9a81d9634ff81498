"""Ordered folds: state that depends on every decision before.

Rows are hashed by key and sorted inside the partitions, and one generator
runs over each sorted partition with the state of the current key only. A key
is never collected, so a hot key takes time but no memory. Batches are read
and written as Arrow columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

TYPES = {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def ordered_fold(df: DataFrame, key: str | list[str], order: list[str], inputs: list[str], step: Callable[..., tuple[Any, tuple]], outputs: str) -> DataFrame:
    """Adds output columns: ``step(state, *inputs)`` returns the next state and the outputs; a key's first state is None.

    ``outputs`` is a schema string.
    """
    keys = [key] if isinstance(key, str) else key
    made = [x.split() for x in outputs.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            rows = []
            for name, *values in zip(names, *(batch.column(c).to_pylist() for c in inputs), strict=True):
                if name != now:
                    now, state = name, None
                state, out = step(state, *values)
                rows.append(out)
            columns = [pa.array(c, TYPES[t]) for c, (_, t) in zip(zip(*rows, strict=True), made, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *(n for n, _ in made)])

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", " + outputs
    return dealt.mapInArrow(run, schema)
