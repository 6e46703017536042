"""Running Python text functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def explode_texts(df: DataFrame, make: Callable[[], Callable[..., list[tuple]]], schema: str) -> DataFrame:
    """For each row of df, the rows that a function of its values returns.

    make is called once in each task and returns the function, so that automata and tables are built there and not
    shipped. One batch is held at a time; a text is never split or shortened.
    """
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(fields)
        function = make()
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out: list[tuple] = []
            for row in zip(*columns):
                out += function(*row)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return df.mapInArrow(run, fields)
