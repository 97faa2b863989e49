"""What the operators share: texts as bytes, digests of texts, one row of each group."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows that a worker turns into Python values at once: a batch of Arrow's has twenty times as many.
ROWS = 512


def sliced(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``rows``, without a copy."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's values as bytes; null: b''."""
    return [x or b"" for x in batch.column(name).cast(pa.large_binary() if pa.types.is_large_string(batch.column(name).type) else pa.binary()).to_pylist()]


def text_key(text: Column) -> Column:
    """A digest of a text; what is found in a text is found in its copies."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def short(key: Column) -> Column:
    """A bigint from a digest, for filters."""
    return F.conv(F.substring(F.hex(key), 1, 15), 16, 10).cast("bigint")


def one_of_each(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The row of ``docs`` of each ``component`` of ``grouped`` (doc_id, h, component) that has the smallest (doc_id, text digest h).

    Rows alike in both are one, of which the least by a hash of its other columns stays. Rows
    with a null doc_id all stay. Columns as in ``docs``, whatever their names.
    """
    best = grouped.groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("b")).select("b.*").distinct()
    rows = docs.where("doc_id is not null").select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("h"))
    rest = [F.col("doc")[c] for c in docs.columns if c != "text"]
    own = rows.join(best.hint("merge"), ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.min_by("doc", F.md5(F.to_json(F.struct(*rest)))).alias("doc"))
    return own.select("doc.*").unionByName(docs.where("doc_id is null"))
