"""Flowering onsets by year and their statistics; the danger index as a listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ONSET_PHASE = 5  # fixed value: the phase that begins flowering


def yearly_onset(rows: DataFrame, stations: list[int] | DataFrame | None = None, phase: int = ONSET_PHASE) -> DataFrame:
    """(species, year, onset_doy): the phase's mean day over the chosen stations, rounded half to even.

    ``rows``: (species, station_id, year, phase, doy), of which those without a day don't count; ``stations``: a list of
    ids, a table with a column station_id, or None for all.
    """
    rows = rows.where((F.col("phase") == phase) & F.col("doy").isNotNull())
    if isinstance(stations, DataFrame):
        rows = rows.join(stations.select("station_id").distinct(), "station_id", "left_semi")
    elif stations is not None:
        rows = rows.where(F.col("station_id").isin(stations))
    return rows.groupBy("species", "year").agg(F.bround(F.avg("doy"), 0).cast("int").alias("onset_doy"))


def onset_stats(onset: DataFrame) -> DataFrame:
    """(species, mean, std, lo, hi, years, first_year, last_year) of (species, year, onset_doy); input of the phenology features."""
    day = F.col("onset_doy")
    return onset.groupBy("species").agg(
        F.avg(day).alias("mean"), F.stddev_samp(day).alias("std"), F.min(day).alias("lo"), F.max(day).alias("hi"), F.count("*").alias("years"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
    )


def danger_listing(levels: DataFrame) -> DataFrame:
    """``levels`` with the level cut to a whole number and a bar of as many blocks, sorted by its other columns."""
    keys = [c for c in levels.columns if c != "level"]
    whole = levels.withColumn("level", F.col("level").cast("int"))
    return whole.withColumn("bar", F.expr("repeat('\u2588', level)")).sort(*keys, "level")
