"""Readers of landed files.  Fetching them isn't this library's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.functions.scalar import danger_code, epoch_window, window_start
from windrow.operators import align, phenology
from windrow.params import CALENDAR, SOIL, SPECIES, WEATHER
from windrow.shared import written

# Fields and parameters of the landed payloads.
MEASUREMENTS = "measurements array<struct<polle: string, location: string, data: array<struct<`from`: bigint, `to`: bigint, value: double>>>>"
HOURLY = [
    "temperature_2m", "precipitation", "wind_speed_10m", "wind_direction_10m", "relative_humidity_2m", "sunshine_duration", "shortwave_radiation", "boundary_layer_height", "dew_point_2m", "cape",
    "direct_radiation", "is_day", "soil_temperature_6cm", "soil_moisture_3_to_9cm", "soil_temperature_0_to_7cm", "soil_moisture_0_to_7cm",
]
WEATHER_JSON = "hourly struct<time: array<string>, " + ", ".join(f"{n}: array<double>" for n in HOURLY) + ">"
SUBSET_JSON = "subset array<struct<calendar_date: string, band: string, data: array<bigint>>>"
DANGER_JSON = "last_update string, content array<struct<partregion_id: int, Pollen: map<string, struct<today: string, tomorrow: string, dayafter_to: string>>>>"
HISTORY = "station string, species string, ts timestamp_ntz, value double, is_measured boolean, " + ", ".join(f"{c} double" for c in WEATHER) + ", " + ", ".join(f"{c} {'int' if c in ('day_of_year', 'month', 'hour_of_day') else 'double'}" for c in CALENDAR) + ", ndvi double, evi double, ndvi_delta double, cams_pollen double, ingest_ts timestamp"
# Names that the danger index, the onset files and the gridded forecast have for species.
DANGER_SPECIES = {"Erle": "Alnus", "Ambrosia": "Ambrosia", "Beifuss": "Artemisia", "Birke": "Betula", "Hasel": "Corylus", "Esche": "Fraxinus", "Graeser": "Poaceae", "Roggen": "Poaceae"}
ONSET_FILES = {"Hasel": "Corylus", "Haenge-Birke": "Betula", "Esche": "Fraxinus", "Beifuss": "Artemisia"}
GRID_SPECIES = {"alder_pollen": "Alnus", "birch_pollen": "Betula", "grass_pollen": "Poaceae", "mugwort_pollen": "Artemisia", "ragweed_pollen": "Ambrosia"}


def of_file(pattern: str) -> Column:
    """What the first group of a pattern takes from the path of the file that a row comes from: one plan reads any number of files."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def named_in_file(names: dict[str, str]) -> Column:
    """The value of the longest key that the name of a row's file or its folder holds, else null (keys are a few fixed names)."""
    name = F.array_join(F.slice(F.split(F.url_decode("_metadata.file_path"), "/"), -2, 2), "/")
    found = F.lit(None).cast("string")
    for key in sorted(names, key=len):  # later ones, which are longer, are asked first
        found = F.when(F.contains(F.lower(name), F.lit(key.lower())), names[key]).otherwise(found)
    return found


def renamed(column: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), column)


def measurements(spark: SparkSession, path: str, species: list[str] | None = None, zone: str = "Europe/Berlin") -> DataFrame:
    """(station, species, ts, value).  Without a whitelist all species but the collective one stay."""
    rows = spark.read.schema(MEASUREMENTS).option("multiLine", True).json(path).select(F.inline("measurements"))
    rows = rows.where(F.col("polle") != "Varia") if species is None else rows.where(F.col("polle").isin(species))
    each = rows.select("location", "polle", F.inline("data"))
    return each.select(F.col("location").alias("station"), F.col("polle").alias("species"), epoch_window(F.col("from"), zone).alias("ts"), "value")


def chunked_measurements(spark: SparkSession, path: str, species: list[str] = SPECIES, zone: str = "Europe/Berlin", chunk: Column | None = None) -> DataFrame:
    """The same with the chunk that each file is of, input of operators.align.merge_chunks: one plan for all files.

    ``chunk`` is a column of the file's metadata, by default its path, so that chunks named by their dates are in order.
    """
    chunk = F.col("_metadata.file_path") if chunk is None else chunk
    rows = spark.read.schema(MEASUREMENTS).option("multiLine", True).json(path).select(chunk.alias("chunk"), F.inline("measurements"))
    each = rows.where(F.col("polle").isin(species)).select("chunk", "location", "polle", F.inline("data"))
    return each.select(F.col("location").alias("station"), F.col("polle").alias("species"), epoch_window(F.col("from"), zone).alias("ts"), "value", "chunk")


def hourly_weather(spark: SparkSession, path: str, station: str | Column) -> DataFrame:
    """(station, time, a column per parameter); parameters that the payload lacks are null.

    ``station``: the station's name, or a column of the file's metadata (``of_file``) where files of many are read.

    Of the soil parameters a payload's first present one is kept, whatever its values, and the other is null.
    """
    raw = spark.read.schema(WEATHER_JSON).option("multiLine", True).json(path)
    empty = F.array().cast("array<double>")  # a null array would null all of arrays_zip
    second = {names[1]: F.col(f"hourly.{names[0]}").isNull() for names in SOIL.values()}
    arrays = [F.col("hourly.time").alias("time"), *[F.when(second.get(n, F.lit(True)) & F.col(f"hourly.{n}").isNotNull(), F.col(f"hourly.{n}")).otherwise(empty).alias(n) for n in HOURLY]]
    each = raw.select((station if isinstance(station, Column) else F.lit(station)).alias("station"), F.inline(F.arrays_zip(*arrays)))
    return each.select("station", F.col("time").try_cast("timestamp_ntz").alias("time"), *HOURLY)


def composites(spark: SparkSession, path: str, station: str | Column, scale: float = 10_000.0) -> DataFrame:
    """(station, date, ndvi, evi) for dates that have an NDVI record; of several records of a band the last of the last file.

    ``station`` as for ``hourly_weather``.
    """
    of = station if isinstance(station, Column) else F.lit(station)
    raw = spark.read.schema(SUBSET_JSON).option("multiLine", True).json(path).select(of.alias("station"), F.col("_metadata.file_path").alias("file"), F.posexplode("subset").alias("pos", "s"))
    band = lambda part: F.max_by(F.col("s.data")[0] / scale, F.when(F.upper("s.band").contains(part), F.struct("file", "pos")))
    by_date = raw.groupBy("station", F.to_date("s.calendar_date").alias("date")).agg(band("NDVI").alias("ndvi"), band("EVI").alias("evi"))
    return by_date.where(F.col("ndvi").isNotNull()).select("station", "date", "ndvi", "evi")


def danger_levels(spark: SparkSession, path: str, region: int, run_date: str, by_line: bool = False) -> DataFrame:
    """(region, date, species, level): maximum per date and species; unknown codes are 0, an unreadable date the run's.

    A file is one payload or, ``by_line``, holds one a line: many payloads are then few files, which split into tasks.
    """
    raw = spark.read.schema(DANGER_JSON).option("multiLine", not by_line).json(path)
    start = F.coalesce(F.try_to_timestamp(F.substring("last_update", 1, 10), F.lit("yyyy-MM-dd")).cast("date"), F.lit(run_date).cast("date"))
    rows = raw.select(start.alias("start"), F.inline("content")).where(F.col("partregion_id") == region).select("start", F.explode("Pollen").alias("name", "days"))
    rows = rows.withColumn("species", renamed(F.col("name"), DANGER_SPECIES)).where(F.col("species").isNotNull())
    each = rows.select("start", "species", F.posexplode(F.array("days.today", "days.tomorrow", "days.dayafter_to")).alias("k", "code"))
    return each.groupBy(F.lit(region).alias("region"), F.date_add("start", F.col("k")).alias("date"), "species").agg(F.max(danger_code(F.col("code"))).alias("level"))


def onset(spark: SparkSession, path: str, species: str | None = None, stations: list[int] | DataFrame | None = None) -> DataFrame:
    """(species, year, onset_doy): flowering onsets of the chosen stations, their mean by year rounded half to even.

    Without ``species`` each file's name tells it (ONSET_FILES); files of other plants are left out.
    """
    raw = spark.read.option("sep", ";").option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    of = F.lit(species) if species is not None else named_in_file(ONSET_FILES)
    raw = raw.select(of.alias("species"), *[F.col(f"`{c}`").alias(c.strip()) for c in raw.columns]).where("species is not null")
    number = lambda c: F.trim(F.col(c)).try_cast("int")
    rows = raw.select(number("Stations_id").alias("station_id"), number("Referenzjahr").alias("year"), number("Phase_id").alias("phase"), number("Jultag").alias("doy"), "species")
    return phenology.yearly_onset(rows, stations)


GRID = "base timestamp_ntz, lat double, lon double, lead_h int, variable string, value double"


def gridded_forecast(spark: SparkSession, path: str, names: dict[str, str] = GRID_SPECIES) -> DataFrame:
    """(lat, lon, species, ts, value): an external forecast on a grid, ``ts`` being the run's base time and the lead hours.

    Of several runs the latest that has an hour of a point is kept; unknown variables and null values are left out.
    """
    raw = spark.read.schema(GRID).parquet(path)
    rows = raw.select("lat", "lon", renamed(F.col("variable"), names).alias("species"), (F.col("base") + F.make_dt_interval(F.lit(0), F.col("lead_h"))).alias("ts"), "base", "value")
    rows = rows.where(F.col("species").isNotNull() & F.col("value").isNotNull())
    return rows.groupBy("lat", "lon", "species", "ts").agg(F.max_by("value", F.struct("base", "value")).alias("value"))


def external_forecast(spark: SparkSession, path: str, stations: DataFrame, hours: int = 3) -> DataFrame:
    """(station, species, ts, cams_pollen): the forecast at each station's nearest grid point, as means by window."""
    points = gridded_forecast(spark, path).groupBy("lat", "lon", "species", window_start(F.col("ts"), hours).alias("ts")).agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    near = align.nearest_grid(written(points, "points"), stations)
    return near.groupBy(*align.KEY).agg((F.sum("total") / F.sum("n")).alias("cams_pollen"))


def history(spark: SparkSession, path: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """The fact table, or its rows from ``start`` on and before ``end``: other months' files aren't listed or read."""
    rows = spark.read.schema(HISTORY).parquet(path)
    return rows if start is None and end is None else align.between(rows, start, end)


def history_csv(spark: SparkSession, path: str, station: str) -> DataFrame:
    """An older CSV history (date, species, value, ...), columns that it lacks being added later by operators.features.complete."""
    raw = spark.read.option("header", True).csv(path)
    numbers = [F.col(c).try_cast("double").alias(c) for c in raw.columns if c not in ("date", "species")]
    return raw.select(F.lit(station).alias("station"), "species", F.col("date").try_cast("timestamp_ntz").alias("ts"), *numbers)
