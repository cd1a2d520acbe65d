"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def documents(docs: DataFrame, path: str) -> None:
    """(station, document) as text files by station."""
    docs.select("station", "document").write.mode("overwrite").partitionBy("station").text(path)


def table(df: DataFrame, path: str, csv: bool = False) -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if csv else writer.parquet(path)

