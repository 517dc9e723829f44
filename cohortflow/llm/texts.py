"""Whole texts through Arrow batches: one output row per input row."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortflow.session import scratch_path

# Rows, and bytes beyond the first row, that one call of a text function gets at most.
ROWS_AT_ONCE = 4096
BYTES_AT_ONCE = 16 << 20

TextFunction = Callable[[list], Sequence]


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of a bounded size, in order."""
    yield from sized(batch, pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))


def sized(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of which each takes a bounded number of bytes; ``sizes`` has those of its rows."""
    at, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > at and (held + size > BYTES_AT_ONCE or i - at >= ROWS_AT_ONCE):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    if at < len(sizes):
        yield batch.slice(at)


def map_texts(
    docs: DataFrame,
    make: Callable[[], TextFunction],
    fields: Sequence[T.StructField],
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
) -> DataFrame:
    """Columns ``keep`` and what ``make()`` says of each text, row by row.

    ``make`` runs once per task and returns a function from a list of texts
    (null texts as None) to one list per field.  Only the named columns are
    read, so other columns may have any name.  An empty frame gives no row.
    """
    keep = list(dict.fromkeys(keep))
    read = keep if text in keep else [*keep, text]
    source = docs.select(*read)
    schema = T.StructType([*[docs.schema[c] for c in keep], *fields])
    arrow = to_arrow_schema(schema)
    n_keep, at_text = len(keep), read.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for whole in batches:
            fn = fn or make()
            for batch in slices(whole, at_text):
                out = fn(batch.column(at_text).to_pylist())
                kept = [batch.column(i).cast(arrow.field(i).type) for i in range(n_keep)]
                made = [
                    pa.array(v, type=arrow.field(n_keep + i).type) for i, v in enumerate(out)
                ]
                yield pa.RecordBatch.from_arrays([*kept, *made], schema=arrow)

    return source.mapInArrow(run, schema)


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back."""
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
