"""Problem 8: encode every document with a public byte-level BPE.

One narrow stage over the scan: Arrow batches go to :class:`bpe.ByteBpe`, a
bounded-lookahead transducer, and come back as a flat id array.  Null and empty
texts give an empty list.  Rows and their order within a partition stay; only
the key and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .bpe import encoder
from .common import tokenizer_path

#: Rows a batch leaves the JVM with are cut to this many, so a worker's memory does not depend on the batch size.
SLICE_ROWS = 512


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): ids without special tokens; [] for an empty, and for a null text."""
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")
    schema = StructType([StructField(key, docs.schema[key].dataType), StructField("ids", ArrayType(IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                flat: list[int] = []
                ends = [0]
                for t in batch.column(1):
                    flat.extend(encode(t.as_py()))
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def decode_corpus(ids: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, text): the inverse, by an incremental byte-to-text machine; null ids give an empty text."""
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            texts = ["".join(e.decode_stream(x or [])) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return ids.select(key, "ids").mapInArrow(run, f"{key} {ids.schema[key].dataType.simpleString()}, text string")


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """df without its text, with the number of tokens; 0 for null and empty texts."""
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")
    keep = [c for c in df.columns if c != text]
    schema = StructType([df.schema[c] for c in keep] + [StructField(out, LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path).count
        for batch in batches:
            n = [count(t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(n, pa.int64())], names=[*keep, out])

    return df.select(*keep, text).mapInArrow(run, schema)
