"""Arrow helpers shared by the operators: token codes of a batch without Python objects per token."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows per Arrow batch between the JVM and Python; keeps a batch of very long texts small.
BATCH_ROWS = 2000


def small_batches(df: DataFrame) -> DataFrame:
    """Sets the rows of an Arrow batch unless the session's owner has: Spark reads that setting only when a query runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def last_delivery(corpus: DataFrame, columns: dict) -> DataFrame:
    """One row per version_id with the given columns of its last delivery.

    A max over a struct, combined before the shuffle: a version delivered very often is no hot group.
    """
    kept = F.max(F.struct("loaded_at", *[c.alias(n) for n, c in columns.items()]))
    return corpus.groupBy("version_id").agg(kept.alias("r")).select("version_id", *[F.col(f"r.{n}").alias(n) for n in columns])


def grouped_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Batches joined to tables of about limit bytes of the column, so that work per chunk is bounded."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.column(b.schema.get_field_index(column)).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def plain(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    return column


def split_tokens(joined: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Tokens of single-space joined texts, and the number of tokens of each row. '' and null have none."""
    joined = pc.fill_null(joined, "")
    empty = pc.equal(joined, "").to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(joined, " ")
    lengths = np.where(empty, 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    tokens = plain(pc.list_flatten(lists))
    return (tokens.filter(pc.not_equal(tokens, "")) if empty.any() else tokens), lengths


def token_codes(joined: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of each token, the distinct tokens, number of tokens of each row)."""
    tokens, lengths = split_tokens(joined)
    coded = tokens.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, lengths
