"""Batches of rows through a Python function, as Arrow, without pandas in between."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from framelens.session import ship


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """fn gets an iterator of batches, each a dict of column lists, and gives such dicts with the columns of schema."""
    return map_batches(df, lambda batches: fn({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)} for b in batches), schema)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """As map_rows, but fn gets the Arrow batches themselves."""
    ship(df.sparkSession)
    struct = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(struct)
        for out in fn(batches):
            yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, struct)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of an array of lists of longs, without Python objects. Null lists have length 0."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), lengths
