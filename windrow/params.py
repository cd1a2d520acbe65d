"""Per-species parameters as a small dimension, and names of the columns of the fact table and of the feature vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.shared import small

# Species, season months, degree-day thresholds, activation temperatures, onset days, level thresholds.
SPECIES = ["Alnus", "Ambrosia", "Artemisia", "Betula", "Corylus", "Fraxinus", "Poaceae", "Populus", "Quercus", "Salix", "Urtica"]
#: species: season start and end month, degree-day threshold, activation temperature, typical onset day, low, moderate, high maximum
SPECIES_PARAMS = {
    "Alnus": (1, 4, 30.0, 5.0, 55, 10.0, 70.0, 250.0),
    "Ambrosia": (7, 10, 800.0, 18.0, 225, 5.0, 20.0, 80.0),
    "Artemisia": (7, 9, 700.0, 16.0, 205, 5.0, 15.0, 50.0),
    "Betula": (3, 5, 150.0, 10.0, 110, 10.0, 50.0, 300.0),
    "Corylus": (1, 4, 20.0, 5.0, 45, 10.0, 70.0, 250.0),
    "Fraxinus": (3, 5, 150.0, 10.0, 105, 10.0, 50.0, 200.0),
    "Poaceae": (5, 9, 400.0, 12.0, 145, 5.0, 30.0, 60.0),
    "Populus": (3, 5, 100.0, 8.0, 95, 10.0, 50.0, 200.0),
    "Quercus": (4, 6, 250.0, 12.0, 125, 10.0, 50.0, 200.0),
    "Salix": (3, 5, 100.0, 8.0, 95, 5.0, 20.0, 50.0),
    "Urtica": (5, 9, 400.0, 12.0, 160, 10.0, 50.0, 200.0),
}
DEFAULT_GDD_THRESHOLD, DEFAULT_ACTIVATION_TEMP, DEFAULT_LEVELS = 200.0, 10.0, (10.0, 50.0, 200.0)
GDD_BASE = 5.0
SCHEMA = "species string, season_start int, season_end int, gdd_threshold double, activation_temp double, typical_onset_doy int, low_max double, moderate_max double, high_max double"

# Fixed values from here to LAG_FEATURES: names of columns; the soil parameters of the forecast and the archive, the first present being taken.
SOIL = {"temperature": ["soil_temperature_6cm", "soil_temperature_0_to_7cm"], "moisture": ["soil_moisture_3_to_9cm", "soil_moisture_0_to_7cm"]}
WEATHER = [
    "temperature_max", "temperature_min", "temperature_mean", "precipitation_sum", "wind_speed_max", "wind_direction", "humidity_mean", "sunshine_duration", "shortwave_radiation_sum",
    "boundary_layer_height", "dew_point_mean", "cape_max", "direct_radiation_sum", "is_day", "temp_slope_3h", "humidity_slope_3h", "temp_variance_3h", "soil_temperature_mean", "soil_moisture_mean",
]
CALENDAR = ["day_of_year", "day_of_year_sin", "day_of_year_cos", "month", "hour_of_day", "hour_sin", "hour_cos"]
DERIVED = [
    "gdd", "temp_rolling_3d", "temp_rolling_7d", "sunshine_rolling_3d", "sunshine_rolling_7d", "rain_rolling_3d", "rain_rolling_7d", "temp_delta_1d", "temp_delta_3d", "temp_x_sunshine", "dry_warm",
    "gdd_above_threshold", "cold_to_warm_flip", "consecutive_warm_hrs", "dry_streak", "warm_after_cold", "wind_x_dry_warm", "wind_dir_sin", "wind_dir_cos", "wind_from_south", "wind_from_north", "transport_south", "transport_north",
]
VEGETATION = ["ndvi", "evi", "ndvi_delta"]
PHENOLOGY = ["days_since_typical_onset", "onset_anomaly"]
INTRADAY = ["temp_vs_daily_max", "precip_in_prior_window", "temp_rate_of_change"]
LAGS = [1, 2, 3, 8, 16, 24, 56]
LAG_FEATURES = [f"lag_{k}" for k in LAGS] + ["rolling_8", "rolling_56", "max_8", "max_56", "morning_avg", "windows_since_active"]
FEATURES = WEATHER + CALENDAR + ["season_active"] + DERIVED + VEGETATION + PHENOLOGY + ["cams_pollen"] + INTRADAY + LAG_FEATURES


def species_params(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in SPECIES_PARAMS.items()], SCHEMA)


def with_params(df: DataFrame, params: DataFrame) -> DataFrame:
    """``df`` with the parameters of its species (a dimension of one row a species; broadcast if it is small), defaults where it is unknown."""
    joined = df.join(small(params), "species", "left")
    defaults = {"gdd_threshold": DEFAULT_GDD_THRESHOLD, "activation_temp": DEFAULT_ACTIVATION_TEMP, "low_max": DEFAULT_LEVELS[0], "moderate_max": DEFAULT_LEVELS[1], "high_max": DEFAULT_LEVELS[2]}
    return joined.fillna(defaults)


def col_or_zero(df: DataFrame, name: str) -> Column:
    """The column with nulls as 0, or 0 where an older file lacks it."""
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)
