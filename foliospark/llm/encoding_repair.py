"""Problem 4 on DataFrames: find and undo wrong decodings.

Row-local, without a shuffle: a worker looks at the set of a text's characters
(:mod:`gate`), and only suspicious values go through :mod:`mojibake`, which maps
characters to legacy bytes, runs the byte-structure automaton and decodes the
well-formed spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gate, mojibake

FIELDS = ("text", "heading_context")


def read_fields(df: DataFrame, key: str) -> DataFrame:
    """(key, text, heading_context)."""
    return df.select(F.col(key), F.col("text").alias("text"), F.col("metadata.heading_context").alias("heading_context"))


def repair_encoding(df: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, field, restored): a row for each field with wrongly decoded characters, restored as far as it goes.

    Null and empty fields never have any.
    """
    src = read_fields(df, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, names, values, ids = [], [], [], b.column(0)
            for name, column in zip(FIELDS, b.columns[1:]):
                for i, v in enumerate(column.to_pylist()):
                    if v and not gate.ordinary(v) and gate.encoding_suspect(v):
                        r = mojibake.restore(v)
                        if mojibake.garbled(v, r):
                            keys.append(i), names.append(name), values.append(r)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keys, pa.int64())), pa.array(names, pa.string()), pa.array(values, pa.string())], names=[key, "field", "restored"])

    return src.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, field string, restored string")
