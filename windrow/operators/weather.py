"""Hourly weather to windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.scalar import window_start
from windrow.params import SOIL


def circular_mean(degrees: Column) -> Column:
    """Mean direction in degrees; a null counts as north."""
    d = F.radians(F.coalesce(degrees, F.lit(0.0)))
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(d)), F.avg(F.cos(d)))), F.lit(360.0))


def slope(value: Column, ts: Column) -> Column:
    """Last less first value that isn't null."""
    known = F.when(value.isNotNull(), ts)
    return F.coalesce(F.max_by(value, known) - F.min_by(value, known), F.lit(0.0))


def first_present(df: DataFrame, names: list[str]) -> Column:
    """Mean of the first of the named columns that has one, else 0.  The reader leaves a payload only the first that it has."""
    return F.coalesce(*[F.avg(n) for n in names if n in df.columns], F.lit(0.0))


def to_windows(hourly: DataFrame, hours: int = 3) -> DataFrame:
    """(station, ts, 19 columns): one row per station and window.  Sums of nothing but nulls are 0; a lone row has variance 0."""
    zero = F.lit(0.0)
    has = lambda n: F.col(n) if n in hourly.columns else F.lit(None).cast("double")
    total = lambda n: F.coalesce(F.sum(has(n)), zero)
    t, rh, at = has("temperature_2m"), has("relative_humidity_2m"), F.col("time")
    return hourly.groupBy("station", window_start(at, hours).alias("ts")).agg(
        F.max(t).alias("temperature_max"), F.min(t).alias("temperature_min"), F.avg(t).alias("temperature_mean"),
        total("precipitation").alias("precipitation_sum"), F.max(has("wind_speed_10m")).alias("wind_speed_max"), circular_mean(has("wind_direction_10m")).alias("wind_direction"),
        F.avg(rh).alias("humidity_mean"), total("sunshine_duration").alias("sunshine_duration"), total("shortwave_radiation").alias("shortwave_radiation_sum"),
        F.avg(has("boundary_layer_height")).alias("boundary_layer_height"), F.avg(has("dew_point_2m")).alias("dew_point_mean"), F.max(has("cape")).alias("cape_max"),
        total("direct_radiation").alias("direct_radiation_sum"), F.max(has("is_day")).alias("is_day"),
        slope(t, at).alias("temp_slope_3h"), slope(rh, at).alias("humidity_slope_3h"), F.coalesce(F.var_samp(t), zero).alias("temp_variance_3h"),
        first_present(hourly, SOIL["temperature"]).alias("soil_temperature_mean"), first_present(hourly, SOIL["moisture"]).alias("soil_moisture_mean"),
    )


def horizon(forecast: DataFrame, days: int) -> DataFrame:
    """Rows within ``days`` days of each station's first window."""
    first = forecast.groupBy("station").agg(F.min("ts").alias("_first"))
    return forecast.join(first, "station").where(F.col("ts") < F.col("_first") + F.make_dt_interval(F.lit(days))).drop("_first")


def window_mean(rows: DataFrame, value: str, hours: int = 3) -> DataFrame:
    """(station, species, ts, value): mean per window of an hourly external forecast."""
    return rows.groupBy("station", "species", window_start(F.col("ts"), hours).alias("ts")).agg(F.avg(value).alias(value))


def one_per_window(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One weather row per (station, ts) of a table that repeats it for each species; equal values, so the maximum stands for them."""
    return rows.groupBy("station", "ts").agg(*[F.max(c).alias(c) for c in columns])
