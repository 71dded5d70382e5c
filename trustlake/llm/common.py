"""Helpers shared by the training-data operators: stage tables, under the names used here, and batch iteration."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from trustlake.functions.storage import discard, new_path, qualified, written  # noqa: F401


new_folder, materialize = new_path, written


#: Rows of an Arrow batch; the JVM and the worker each hold one, however long its texts are.
BATCH_ROWS = 1000


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, in whose session rows go to Python in batches of BATCH_ROWS at most."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """The strings of a column, null as the empty string."""
    for value in batch.column(batch.schema.get_field_index(name)):
        yield value.as_py() or ""


def utf8(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, null as no bytes."""
    for value in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()):
        yield value.as_py() or b""


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
