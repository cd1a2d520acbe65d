"""Window features of the measured series and of the weather table.  Frames count rows; every window has partition keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windrow.operators import sharded
from windrow.params import DERIVED, GDD_BASE, LAGS, col_or_zero
from windrow.functions.scalar import onset_anomaly, wind_vector

KEYS = ["station", "species"]


def _lag_columns(parts: list[str]) -> dict[str, Column]:
    s = Window.partitionBy(*parts).orderBy("ts")
    columns: dict[str, Column] = {f"lag_{k}": F.lag("_log", k).over(s) for k in LAGS}
    for n in (8, 56):
        columns[f"rolling_{n}"] = F.avg("_log").over(s.rowsBetween(-n, -1))
        columns[f"max_{n}"] = F.max("_log").over(s.rowsBetween(-n, -1))
    day = Window.partitionBy(*parts, "_day").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    return columns | {"morning_avg": F.coalesce(F.avg("_log").over(day), F.lit(0.0))}


def _time_lag_columns(parts: list[str], step: int) -> dict[str, Column]:
    s = Window.partitionBy(*parts).orderBy("_epoch")
    columns: dict[str, Column] = {f"lag_{k}": F.max("_log").over(s.rangeBetween(-k * step, -k * step)) for k in LAGS}
    for n in (8, 56):
        columns[f"rolling_{n}"] = F.avg("_log").over(s.rangeBetween(-n * step, -1))
        columns[f"max_{n}"] = F.max("_log").over(s.rangeBetween(-n * step, -1))
    day = Window.partitionBy(*parts, "_day").orderBy("_epoch").rangeBetween(Window.unboundedPreceding, -1)
    return columns | {"morning_avg": F.coalesce(F.avg("_log").over(day), F.lit(0.0))}


def _time_lag_features(df: DataFrame, shard_days: int | None, hours: int) -> DataFrame:
    step, active = 3600 * hours, F.when(F.col("value") > 0, F.col("_epoch"))
    df = df.withColumn("_log", F.log1p("value")).withColumn("_day", F.to_date("ts")).withColumn("_epoch", F.unix_seconds(F.col("ts").cast("timestamp")))
    if shard_days:
        df = sharded.with_time_halo(sharded.with_ends(df, active, KEYS, shard_days), shard_days, max(LAGS) * step)
        parts = [*KEYS, sharded.SHARD]
    else:
        df, parts = df.withColumns({"_active_before": F.lit(None).cast("long"), "_first_before": F.lit(None).cast("long")}), KEYS
    upto = Window.partitionBy(*parts).orderBy("_epoch").rangeBetween(Window.unboundedPreceding, -1)
    last = F.greatest(F.max(active).over(upto), F.col("_active_before"))
    first = F.least(F.min("_epoch").over(Window.partitionBy(*parts)), F.col("_first_before"))
    since = F.when(F.col("_epoch") == first, 999.0).otherwise(F.coalesce((F.col("_epoch") - last) / step - 1, (F.col("_epoch") - first) / step))
    df = df.withColumns(_time_lag_columns(parts, step) | {"windows_since_active": since})
    return (sharded.drop_halo(df) if shard_days else df).drop("_log", "_day", "_epoch", "_active_before", "_first_before")


def lag_features(df: DataFrame, shard_days: int | None = None, frames: str = "rows", hours: int = 3) -> DataFrame:
    """Lags, shifted rolling means and maxima of log1p(value), today's earlier mean, windows since the last positive value.

    All share one shuffle on (station, species), which also serves the frame within a day.  ``shard_days``: series are
    cut into shards of so many days, for those too long for one task; the rows are the same.  ``frames``: "rows" counts
    rows, so that gaps shift what a lag means; "time" counts ``hours`` on the clock: lag_8 is the value 8 windows ago or
    null, rolling_8 the mean of those of the last 8 windows that are there.
    """
    if frames not in ("rows", "time"):
        raise ValueError(f"frames are {frames!r}")
    if frames == "time":
        return _time_lag_features(df, shard_days, hours)
    df = df.withColumn("_log", F.log1p("value")).withColumn("_day", F.to_date("ts"))
    if shard_days:
        df = sharded.with_halo(sharded.since_active(df, KEYS, shard_days), KEYS, shard_days, max(LAGS))
        return sharded.drop_halo(df.withColumns(_lag_columns([*KEYS, sharded.SHARD]))).drop("_log", "_day")
    s = Window.partitionBy(*KEYS).orderBy("ts")
    df = df.withColumn("_rn", F.row_number().over(s))
    past = s.rowsBetween(Window.unboundedPreceding, -1)
    last_active = F.last(F.when(F.col("value") > 0, F.col("_rn")), ignorenulls=True).over(past)
    since = F.when(F.col("_rn") == 1, F.lit(999)).otherwise(F.col("_rn") - 1 - F.coalesce(last_active, F.lit(0)))
    columns = _lag_columns(KEYS) | {"windows_since_active": since.cast("double")}
    return df.withColumns(columns).drop("_log", "_rn", "_day")


def drop_warm_up(df: DataFrame) -> DataFrame:
    return df.dropna(subset=[f"lag_{k}" for k in LAGS])


def _intraday_columns(parts: list[str]) -> dict[str, Column]:
    w, day = Window.partitionBy(*parts).orderBy("ts"), Window.partitionBy(*parts, F.to_date("ts"))
    t, top = F.col("temperature_mean"), F.max("temperature_mean").over(day)
    return {
        "temp_vs_daily_max": F.when(top > 0, t / top).otherwise(0.0),
        "precip_in_prior_window": F.coalesce((F.lag("precipitation_sum").over(w) > 0.1).cast("double"), F.lit(0.0)),
        "temp_rate_of_change": F.coalesce(t - F.lag("temperature_mean").over(w), F.lit(0.0)),
    }


def intraday_features(weather: DataFrame) -> DataFrame:
    return weather.withColumns(_intraday_columns(["station"]))


def degree_days(daily: DataFrame, base: float = GDD_BASE, keys: tuple[str, ...] = ("station",)) -> DataFrame:
    """(keys, date, gdd): sum of max(0, temperature - base) since the first day of the data in each calendar year."""
    w = Window.partitionBy(*keys, F.year("date")).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("gdd", F.sum(F.greatest(F.col("temperature") - base, F.lit(0))).over(w))


def streak(df: DataFrame, holds: Column, name: str, keys: list[str], shard_days: int | None = None) -> DataFrame:
    """Consecutive rows up to this one where ``holds``; 0 where it doesn't (nulls don't)."""
    if shard_days:
        return sharded.streak(df, holds, name, keys, shard_days)
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_m", F.coalesce(holds, F.lit(False)).cast("int"))
    df = df.withColumn("_island", F.sum(1 - F.col("_m")).over(w))
    within = Window.partitionBy(*keys, "_island").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum("_m").over(within).cast("double")).drop("_m", "_island")


def _rolling_columns(parts: list[str]) -> dict[str, Column]:
    w = Window.partitionBy(*parts).orderBy("ts")
    columns: dict[str, Column] = {}
    for days, n in ((3, 24), (7, 56)):
        frame = w.rowsBetween(1 - n, 0)
        columns[f"temp_rolling_{days}d"] = F.avg("temperature_mean").over(frame)
        columns[f"sunshine_rolling_{days}d"] = F.avg("sunshine_duration").over(frame)
        columns[f"rain_rolling_{days}d"] = F.sum("precipitation_sum").over(frame)
    for name, n in (("temp_delta_1d", 8), ("temp_delta_3d", 24)):
        columns[name] = F.coalesce(F.col("temperature_mean") - F.lag("temperature_mean", n).over(w), F.lit(0.0))
    return columns


def _time_rolling_columns(parts: list[str], step: int) -> dict[str, Column]:
    w = Window.partitionBy(*parts).orderBy("_epoch")
    columns: dict[str, Column] = {}
    for days, n in ((3, 24), (7, 56)):
        frame = w.rangeBetween((1 - n) * step, 0)
        columns[f"temp_rolling_{days}d"] = F.avg("temperature_mean").over(frame)
        columns[f"sunshine_rolling_{days}d"] = F.avg("sunshine_duration").over(frame)
        columns[f"rain_rolling_{days}d"] = F.sum("precipitation_sum").over(frame)
    for name, n in (("temp_delta_1d", 8), ("temp_delta_3d", 24)):
        columns[name] = F.coalesce(F.col("temperature_mean") - F.max("temperature_mean").over(w.rangeBetween(-n * step, -n * step)), F.lit(0.0))
    return columns


def rolling_weather(weather: DataFrame, frames: str = "rows", hours: int = 3, shard_days: int | None = None) -> DataFrame:
    """Rolling means and sums over 24 and 56 windows, the current one included, and changes over 8 and 24.

    ``frames``: "rows" counts rows, "time" ``hours`` on the clock (operators.features.lag_features); ``shard_days`` as there.
    """
    if frames not in ("rows", "time"):
        raise ValueError(f"frames are {frames!r}")
    parts = ["station", sharded.SHARD] if shard_days else ["station"]
    if frames == "rows":
        rows = sharded.with_halo(weather, ["station"], shard_days, 56) if shard_days else weather
        out = rows.withColumns(_rolling_columns(parts))
    else:
        rows = weather.withColumn("_epoch", F.unix_seconds(F.col("ts").cast("timestamp")))
        rows = sharded.with_time_halo(rows, shard_days, 56 * 3600 * hours) if shard_days else rows
        out = rows.withColumns(_time_rolling_columns(parts, 3600 * hours)).drop("_epoch")
    return sharded.drop_halo(out) if shard_days else out


def sharded_weather(weather: DataFrame, shard_days: int) -> DataFrame:
    """``intraday_features`` and ``rolling_weather`` by shards of so many days."""
    parts = ["station", sharded.SHARD]
    rows = sharded.with_halo(weather, ["station"], shard_days, 56)
    return sharded.drop_halo(rows.withColumns(_intraday_columns(parts) | _rolling_columns(parts)))


def interactions(weather: DataFrame) -> DataFrame:
    dry_warm = F.col("temperature_mean") * (100 - F.col("humidity_mean")) / 100
    wind = wind_vector(col_or_zero(weather, "wind_direction"), F.col("wind_speed_max"))
    return weather.withColumns({"temp_x_sunshine": F.col("temperature_mean") * F.col("sunshine_duration") / 3600, "dry_warm": dry_warm, "wind_x_dry_warm": F.col("wind_speed_max") * dry_warm, **wind})


def weather_features(weather: DataFrame, shard_days: int | None = None) -> DataFrame:
    """All that depends on the station alone, once per (station, window): rolling, streak, degree days, interactions.

    Degree days are windows over the days of one year, whatever the shards.
    """
    df = interactions(weather)
    df = sharded_weather(df, shard_days) if shard_days else rolling_weather(intraday_features(df))
    df = streak(df, F.col("precipitation_sum") < 0.1, "dry_streak", ["station"], shard_days)
    daily = weather.groupBy("station", F.to_date("ts").alias("date")).agg(F.avg("temperature_mean").alias("temperature"))
    daily = degree_days(daily).select("station", "date", "gdd")
    return df.withColumn("date", F.to_date("ts")).join(daily, ["station", "date"], "left").drop("date")


def threshold_features(df: DataFrame, shard_days: int | None = None) -> DataFrame:
    """What depends on the species' thresholds, for rows of (station, species, ts) with weather features and parameters."""
    r3, r7, act = F.col("temp_rolling_3d"), F.col("temp_rolling_7d"), F.col("activation_temp")
    df = df.withColumns({
        "gdd_above_threshold": F.greatest(F.lit(0.0), F.col("gdd") - F.col("gdd_threshold")),
        "cold_to_warm_flip": ((r3 > act) & (r7 < act) & (F.col("gdd") >= F.col("gdd_threshold"))).cast("double"),
        "warm_after_cold": r3 - r7,
        "onset_anomaly": onset_anomaly(F.col("gdd"), F.col("gdd_threshold")),
    })
    return streak(df, F.col("temperature_mean") > act, "consecutive_warm_hrs", KEYS, shard_days)


def complete(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with each of the named columns, 0 where it is null or wasn't there."""
    return df.withColumns({n: col_or_zero(df, n) for n in names})


__all__ = ["DERIVED", "complete", "degree_days", "drop_warm_up", "interactions", "intraday_features", "lag_features", "rolling_weather", "sharded_weather", "streak", "threshold_features", "weather_features"]
