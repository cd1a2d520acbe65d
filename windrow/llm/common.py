"""Helpers that the text operators share: tables, Arrow rows, hashed remainders of ids."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.shared import shared_dir, written

__all__ = ["as_bytes", "column_rows", "remainder", "shared_dir", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_rows(column: pa.ChunkedArray | pa.Array, step: int = 128) -> Iterator:
    """Python values of an Arrow column, a few at a time, so that a batch of long texts isn't held twice."""
    for start in range(0, len(column), step):
        yield from column.slice(start, step).to_pylist()


def as_bytes(column: pa.Array) -> pa.Array:
    """A string column as its UTF-8 bytes, without copying."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def remainder(doc_id: str, by: int):
    """crc32 of an id's decimal text, modulo ``by``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(by))
