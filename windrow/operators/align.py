"""Merging sources, joining them to the fact table, upserts, audits."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windrow.functions.scalar import calendar
from windrow.shared import delete, exists, folders, rename, small

KEY = ["station", "species", "ts"]


def keep_last(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last by ``order``.  Ties need a full order to be stable."""
    w = Window.partitionBy(*key).orderBy(*[c.desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_aliases(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Maximum per (station, species, ts) after alias codes are replaced (``aliases``: alias, station)."""
    named = rows.join(small(aliases), rows["station"] == aliases["alias"], "left").select(F.coalesce(aliases["station"], rows["station"]).alias("station"), "species", "ts", "value")
    return named.groupBy(*KEY).agg(F.max("value").alias("value"))


def merge_chunks(rows: DataFrame) -> DataFrame:
    """Maximum per chunk and key, then of the chunks the last that has the key."""
    best = rows.groupBy(*KEY, "chunk").agg(F.max("value").alias("value"))
    return best.groupBy(*KEY).agg(F.max_by("value", "chunk").alias("value"))


def prefer(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Union in which ``first`` wins where both have a key."""
    both = first.withColumn("_p", F.lit(1)).unionByName(second.withColumn("_p", F.lit(0)), allowMissingColumns=True)
    return keep_last(both, key, [F.col("_p")]).drop("_p")


def densify(values: DataFrame, windows: DataFrame, species: list[str]) -> DataFrame:
    """Every window times every species, value 0 where none was measured; is_measured tells which were."""
    grid = windows.select("station", "ts").distinct().withColumn("species", F.explode(F.array(*map(F.lit, species))))
    joined = grid.join(values.select(*KEY, "value"), KEY, "left")
    return joined.select(*KEY, F.coalesce("value", F.lit(0.0)).alias("value"), F.col("value").isNotNull().alias("is_measured"))


def attach(df: DataFrame, other: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Left join that gives 0 where there is no row or a null."""
    joined = df.join(other.select(*on, *columns), on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns})


def attach_daily(df: DataFrame, daily: DataFrame, columns: list[str]) -> DataFrame:
    return attach(df.withColumn("date", F.to_date("ts")), daily, ["station", "date"], columns).drop("date")


def build_history(values: DataFrame, weather: DataFrame, vegetation: DataFrame | None, external: DataFrame | None, species: list[str], as_of: Column | None = None) -> DataFrame:
    """The fact table's rows: measured windows that have weather, for every species, with calendar, vegetation and the external forecast."""
    if as_of is not None:
        weather = weather.where(F.col("ts") <= as_of)
    windows = values.select("station", "ts").distinct().join(weather.select("station", "ts"), ["station", "ts"], "left_semi")
    df = densify(values, windows, species).join(weather, ["station", "ts"]).withColumns(calendar(F.col("ts")))
    if vegetation is not None:
        df = attach_daily(df, vegetation, ["ndvi", "evi", "ndvi_delta"])
    return df if external is None else attach(df, external, KEY, ["cams_pollen"])


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Union keyed by (station, species, ts), rows of the later ingest_ts winning."""
    both = stored.unionByName(new, allowMissingColumns=True)
    return keep_last(both, KEY, [F.col("ingest_ts"), F.col("value")])


def _month(ts: Column) -> Column:
    return F.to_date(F.trunc(F.to_date(ts), "month"))


def months_of(spark: SparkSession, path: str) -> list[datetime.date]:
    """The months that a table by month_start has, from its folders' names."""
    names = [n.removeprefix("month_start=") for n in folders(spark, path) if n.startswith("month_start=")]
    return [datetime.date.fromisoformat(n) for n in names if n != "__HIVE_DEFAULT_PARTITION__"]


def recover(spark: SparkSession, path: str) -> None:
    """Settle a swap that was broken off: a month whose new version isn't there gets its old one back."""
    for swap in folders(spark, f"{path}/_replaced"):
        for month in folders(spark, f"{path}/_replaced/{swap}"):
            if not exists(spark, f"{path}/{month}"):
                rename(spark, f"{path}/_replaced/{swap}/{month}", f"{path}/{month}")
    delete(spark, f"{path}/_replaced")


def _swap(spark: SparkSession, path: str, staged: str, swap: str) -> None:
    """Put the staged months in the place of the table's, one after the other; old versions go when all are in place."""
    for month in folders(spark, staged):
        if exists(spark, f"{path}/{month}"):
            rename(spark, f"{path}/{month}", f"{path}/_replaced/{swap}/{month}")
        rename(spark, f"{staged}/{month}", f"{path}/{month}")
    delete(spark, f"{path}/_replaced/{swap}")


def upsert_table(path: str, new: DataFrame, staging: str | None = None) -> None:
    """Upsert into a Parquet table partitioned by month_start: only the months of ``new`` are read, staged and rewritten.

    ``new`` is computed once, as it is staged by month.  Merged months are dealt out by ranges of the key from sampled
    bounds, so that a month of many rows is written by several tasks to several files, each sorted by the key.  The table
    isn't touched until all are staged; then whole folders are moved.  An upsert that failed can be run again: ``recover``
    puts back what a broken swap had moved aside, and keyed rows come out the same.  ``staging`` must be on the table's file
    system; by default it is a hidden folder in it.  One upsert of a table runs at a time.
    """
    spark, swap = new.sparkSession, uuid.uuid4().hex
    recover(spark, path)
    root = f"{staging or f'{path}/_staging'}/{swap}"
    new.withColumn("month_start", _month(F.col("ts"))).write.partitionBy("month_start").parquet(f"{root}/new")
    months = months_of(spark, f"{root}/new")
    if months:
        fresh = spark.read.schema(new.schema).parquet(f"{root}/new")
        known = sorted(set(months) & set(months_of(spark, path)))
        stored = spark.read.option("basePath", path).option("mergeSchema", True).parquet(*[f"{path}/month_start={m}" for m in known]) if known else None
        rows = keep_last(fresh, KEY, [F.col("ingest_ts"), F.col("value")]) if stored is None else upsert(stored, fresh)
        rows = rows.repartitionByRange("month_start", *KEY).sortWithinPartitions("month_start", *KEY)
        rows.write.partitionBy("month_start").parquet(f"{root}/merged")
        _swap(spark, path, f"{root}/merged", swap)
    delete(spark, root)


def retain(df: DataFrame, as_of: Column, days: int = 730) -> DataFrame:
    """The rows of the last ``days``; of a table by month_start only the months that may have some are read."""
    start = as_of - F.make_dt_interval(F.lit(days))
    kept = df.where(F.col("ts") >= start)
    return kept.where(F.col("month_start") >= _month(start)) if "month_start" in df.columns else kept


def between(df: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows with start <= ts < end of a table by month_start, other months not being read."""
    if start is not None:
        df = df.where((F.col("ts") >= start) & (F.col("month_start") >= _month(start)))
    return df if end is None else df.where((F.col("ts") < end) & (F.col("month_start") <= _month(end)))


def expire(spark: SparkSession, path: str, as_of: datetime.datetime, days: int = 730) -> list[datetime.date]:
    """Drop the months of a table by month_start that end before the last ``days``, by their folders; returns them.

    Nothing is read or rewritten, so the oldest month that stays may have older rows, which ``retain`` leaves out.
    """
    recover(spark, path)
    start = (as_of - datetime.timedelta(days=days)).date()
    gone = [m for m in months_of(spark, path) if (m.replace(day=28) + datetime.timedelta(days=4)).replace(day=1) <= start]
    for m in gone:
        delete(spark, f"{path}/month_start={m}")
    return gone


def daily_only(df: DataFrame) -> DataFrame:
    """(station, species, is_daily): all rows at midnight."""
    return df.groupBy("station", "species").agg(F.every(F.hour("ts") == 0).alias("is_daily"))


def split(df: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(rows before a time, rows from it on): what a model may learn from, and what it is tested on."""
    return df.where(F.col("ts") < at), df.where(F.col("ts") >= at)


def common_days(a: DataFrame, b: DataFrame) -> DataFrame:
    """(date): days on which both have rows."""
    days = lambda df: df.select(F.to_date("ts").alias("date"))
    return days(a).intersect(days(b))


def coverage_audit(dates: DataFrame, start: Column, end: Column, slack: int = 32, overlap: int = 16) -> DataFrame:
    """(station, covered, refetch_from): whether the stored dates reach within ``slack`` days of both ends, and where to fetch from."""
    span = dates.groupBy("station").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    covered = (F.col("lo") <= F.date_add(start, slack)) & (F.col("hi") >= F.date_add(end, -slack))
    return span.select("station", covered.alias("covered"), F.greatest(start, F.date_add("hi", -overlap)).alias("refetch_from"))


def chunks(ranges: DataFrame, days: int = 28) -> DataFrame:
    """(station, chunk_start, chunk_end) of each [start, end]."""
    each = ranges.withColumn("chunk_start", F.explode(F.sequence("start", "end", F.make_dt_interval(F.lit(days)))))
    return each.select("station", "chunk_start", F.least(F.col("end"), F.date_add("chunk_start", days - 1)).alias("chunk_end"))


def profile(df: DataFrame) -> DataFrame:
    """(species, windows, days, nonzero, first_ts, last_ts)."""
    return df.groupBy("species").agg(F.count("*").alias("windows"), F.countDistinct(F.to_date("ts")).alias("days"), F.count_if(F.col("value") > 0).alias("nonzero"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def pivot_species(df: DataFrame, species: list[str]) -> DataFrame:
    return df.groupBy("station", "ts").pivot("species", species).agg(F.avg("value")).fillna(0.0)


def nearest_grid(grid: DataFrame, stations: DataFrame, most_axis: int = 20_000) -> DataFrame:
    """Per station the rows at the nearest latitude and, on its own, the nearest longitude; ties take the smaller one.

    Each row of a point comes once for every station that is nearest to it, so what is to be summed up is best summed up
    by point before.  The grid is read three times: it should be a
    table.  Its axes, some hundreds of numbers however many rows it has, are gathered; longer ones are an error.
    """

    def nearest(axis: str) -> Column:
        values = sorted(r[0] for r in grid.select(axis).where(F.col(axis).isNotNull()).distinct().limit(most_axis + 1).collect())
        if len(values) > most_axis:
            raise ValueError(f"{axis} has more than {most_axis} values: that is no grid")
        pairs = F.transform(F.array(*map(F.lit, values)), lambda x: F.struct(F.abs(x - F.col(f"station_{axis}")).alias("d"), x.alias("x")))
        return F.array_min(pairs)["x"]

    return grid.join(stations.select("station", nearest("lat").alias("lat"), nearest("lon").alias("lon")), ["lat", "lon"])
