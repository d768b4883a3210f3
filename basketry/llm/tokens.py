"""Problem 7: token ids of the whole corpus by a public byte-level BPE vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import DEFAULT_VOCABULARY, Encoder

_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str = DEFAULT_VOCABULARY) -> Encoder:
    """One encoder per Python worker, with its cache of words."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _texts(column: pa.Array) -> list[str | None]:
    return column.cast(pa.string()).to_pylist()


def encode_texts(frame: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(key, ids array<int>)`` for every row of ``frame``.

    Null and empty texts have an empty list; a null key stays null; repeated rows stay repeated; names of
    special tokens are ordinary text. No shuffle: each task reads, encodes and hands on its own rows.
    Columns other than the two named are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = encoder(vocabulary)
        for batch in batches:
            for part in _pieces(batch):
                ids, counts = worker.encode(_texts(part.column(1)))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32, copy=False)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["key", "ids"])

    kind = frame.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    out = frame.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
    return out.select(F.col("key").alias(key), "ids")


def _pieces(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``most`` bytes, so that a worker's memory is bounded by the largest text."""
    if not batch.num_rows:
        return
    size = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def count_tokens(frame: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(key, tokens bigint)`` for every row, 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = encoder(vocabulary)
        for batch in batches:
            for part in _pieces(batch):
                counts = worker.encode(_texts(part.column(1)), counts_only=True)[1]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], names=["key", "tokens"])

    schema = T.StructType([T.StructField("key", frame.schema[key].dataType), T.StructField("tokens", T.LongType())])
    out = frame.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
    return out.select(F.col("key").alias(key), "tokens")
