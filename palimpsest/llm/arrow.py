"""Map-only Python stages over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def map_rows(df: DataFrame, schema: T.StructType | str, fn: Callable[..., Iterable[tuple]]) -> DataFrame:
    """Apply fn to each row's values and emit the tuples it yields; rows of a batch go out together.

    Works batch by batch, so memory is bounded by the largest batch, and needs no state.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)

    def run(batches):
        out_schema = to_arrow_schema(schema)
        for b in batches:
            rows = []
            for row in zip(*[c.to_pylist() for c in b.columns]):
                rows.extend(fn(*row))
            cols = list(zip(*rows)) if rows else [[] for _ in out_schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, out_schema)], schema=out_schema)

    return df.mapInArrow(run, schema)
