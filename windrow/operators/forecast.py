"""Forecast state, the model-free recursion with assimilation, and output documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windrow.functions.scalar import blend

KEYS = ["station", "species"]


def recent_logs(df: DataFrame, n: int = 56) -> DataFrame:
    """(station, species, logs): the last n values as log1p, oldest first, padded with zeros on the left."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc("ts"))
    last = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    logs = last.groupBy(*KEYS).agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", F.log1p("value").alias("v")))), lambda s: s["v"]).alias("logs"))
    return logs.select(*KEYS, F.concat(F.array_repeat(F.lit(0.0), F.lit(n) - F.size("logs")), "logs").alias("logs"))


def recent_state(df: DataFrame, n: int = 56) -> DataFrame:
    """(station, species, logs, run, today, day, last): what a recursion goes on from after a series' rows.

    ``logs`` as of ``recent_logs``; ``run``: the rows since the last one of a positive value, however far back; ``today``:
    the logs of the last row's ``day``, oldest first; ``last``: the last row's time.
    """
    ends = df.groupBy(*KEYS).agg(F.max("ts").alias("last"), F.max(F.when(F.col("value") > 0, F.col("ts"))).alias("active"))
    rows = df.select(*KEYS, "ts", "value").join(ends, KEYS)
    entry = F.when(F.to_date("ts") == F.to_date("last"), F.struct("ts", F.log1p("value").alias("v")))
    sums = rows.groupBy(*KEYS).agg(F.count_if(F.col("active").isNull() | (F.col("ts") > F.col("active"))).alias("run"), F.transform(F.sort_array(F.collect_list(entry)), lambda s: s["v"]).alias("today"), F.to_date(F.max("last")).alias("day"), F.max("last").alias("last"))
    return recent_logs(df, n).join(sums, KEYS)


def bridge_gaps(state: DataFrame, begins: DataFrame, on_gap: str = "decay", hours: int = 3, decay: float = 0.8, n: int = 56) -> DataFrame:
    """``state`` (of ``recent_state``) brought up to each series' first window in ``begins``: (station, species, first).

    A recursion counts windows, so a state must end right before the first one.  "decay" puts a window in for each that is
    missing, with ``decay`` of the value before, as a series without a model goes on; "error" fails on the first such
    series.  Series that aren't in ``begins`` are left out.
    """
    if on_gap not in ("decay", "error"):
        raise ValueError(f"on_gap is {on_gap!r}")
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    df = state.join(begins.select(*KEYS, "first"), KEYS)
    df = df.withColumn("_g", F.greatest(F.lit(0), F.floor((seconds("first") - seconds("last")) / (3600 * hours)).cast("int") - 1))
    if on_gap == "error":
        name = F.concat_ws(" ", F.lit("windows are missing before the first one of"), "station", "species")
        return df.withColumn("_g", F.when(F.col("_g") > 0, F.raise_error(name).cast("int")).otherwise(F.col("_g"))).where("_g = 0").drop("_g", "first")
    start = F.greatest(F.lit(1), F.col("_g") - (n + 24 // hours))  # earlier ones are beyond the state
    k = F.when(F.col("_g") > 0, F.sequence(start, F.col("_g"))).otherwise(F.array().cast("array<int>"))
    value = lambda i: F.log1p(F.expm1("_end") * F.pow(F.lit(decay), i))
    at = lambda i: F.to_date(F.col("last") + F.make_dt_interval(F.lit(0), i * hours))
    df = df.withColumn("_k", k).withColumn("_end", F.element_at("logs", -1))
    of_day = F.transform(F.filter("_k", lambda i: at(i) == F.to_date("first")), value)
    today = F.when(F.col("day") == F.to_date("first"), F.concat("today", of_day)).otherwise(of_day)
    run = F.when(F.col("_end") > 0, F.col("run")).otherwise(F.col("run") + F.col("_g"))
    last = F.col("first") - F.make_dt_interval(F.lit(0), F.lit(hours))
    return df.select(*KEYS, F.slice(F.concat("logs", F.transform("_k", value)), -n, n).alias("logs"), run.alias("run"), F.when(F.col("_g") > 0, today).otherwise(F.col("today")).alias("today"), F.when(F.col("_g") > 0, F.to_date("first")).otherwise(F.col("day")).alias("day"), F.when(F.col("_g") > 0, last).otherwise(F.col("last")).alias("last"))


def day_index(windows: DataFrame) -> DataFrame:
    return windows.withColumn("day_index", F.dense_rank().over(Window.partitionBy("station").orderBy(F.to_date("ts"))) - 1)


def fallback(last: DataFrame, steps: DataFrame, decay: float = 0.8) -> DataFrame:
    """(station, species, ts, value, is_observed): each step the observed value if there is one, else the last value times
    ``decay``; a step whose gate is shut gives 0, and the recursion goes on from it.

    ``last``: (station, species, value).  ``steps``: (station, species, ts, observed, open), a forecast horizon's rows a
    series, which a fold over one array per series turns into values.
    """
    rows = steps.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("ts", "observed", "open"))).alias("s")).join(last, KEYS, "left")
    start = F.struct(F.coalesce(F.col("value"), F.lit(0.0)).alias("v"), F.array().cast("array<double>").alias("out"))

    def step(acc, s):
        v = F.when(s["open"], F.coalesce(s["observed"], acc["v"] * decay)).otherwise(0.0)
        return F.struct(v.alias("v"), F.concat(acc["out"], F.array(v)).alias("out"))

    folded = rows.withColumn("out", F.aggregate("s", start, step)["out"])
    each = folded.select(*KEYS, F.explode(F.arrays_zip("s", "out")).alias("z"))
    return each.select(*KEYS, F.col("z.s.ts").alias("ts"), F.col("z.out").alias("value"), F.col("z.s.observed").isNotNull().alias("is_observed"))


def assimilate(forecast: DataFrame, observed: DataFrame, expert: DataFrame) -> DataFrame:
    """``forecast`` with value, is_observed: the observed value where there is one, else the forecast blended with the
    expert's level of that (species, day), where there is one.  Needs the species' level limits."""
    df = forecast.withColumn("date", F.to_date("ts")).join(observed.select(*KEYS, "ts", "observed"), [*KEYS, "ts"], "left").join(expert.select("species", "date", F.col("level").alias("expert")), ["species", "date"], "left")
    blended = blend(F.col("value"), F.col("expert"), F.col("low_max"), F.col("moderate_max"), F.col("high_max"))
    return df.withColumn("value", F.coalesce("observed", blended)).withColumn("is_observed", F.col("observed").isNotNull()).drop("date", "observed", "expert")


def ranked(df: DataFrame) -> DataFrame:
    """(station, ts, species): the species of each window by falling value, then by name."""
    names = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("value")).alias("v"), "species"))), lambda s: s["species"])
    return df.groupBy("station", "ts").agg(names.alias("species"))


def emitted(forecast: DataFrame) -> DataFrame:
    return forecast.where(F.col("value") > 0.5)


def window_document(forecast: DataFrame, generated: str) -> DataFrame:
    """(station, document): day, then windows, then species by falling value; JSON.  Windows without species stay, empty."""
    kept = F.when(F.col("value") > 0.5, F.struct((-F.col("value")).alias("o"), F.col("species").alias("name"), "level", F.bround("value", 1).alias("value"), F.bround("confidence", 3).alias("confidence")))
    names = F.transform(F.sort_array(F.collect_list(kept)), lambda s: F.struct(s["name"].alias("name"), s["level"].alias("level"), s["value"].alias("value"), s["confidence"].alias("confidence")))
    windows = forecast.groupBy("station", "ts").agg(names.alias("species"))
    text = lambda c, f: F.date_format(c, f)
    end = F.col("ts") + F.expr("interval 3 hours")
    window = F.struct(text("ts", "HH:mm").alias("from"), F.when(F.hour(end) == 0, "24:00").otherwise(text(end, "HH:mm")).alias("to"), "species")
    days = windows.groupBy("station", F.to_date("ts").alias("date")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", window.alias("w")))), lambda s: s["w"]).alias("windows"))
    body = F.transform(F.sort_array(F.collect_list(F.struct("date", "windows"))), lambda d: F.struct(d["date"].cast("string").alias("date"), d["windows"].alias("windows")))
    doc = days.groupBy("station").agg(body.alias("forecast"))
    return doc.select("station", F.to_json(F.struct(F.lit(generated).alias("generated"), F.col("station").alias("location"), "forecast")).alias("document"))


def web_measurements(forecast: DataFrame, zone: str = "Europe/Berlin") -> DataFrame:
    """(station, species, from, to, value): wall-clock windows as epoch seconds, local midnight after the last of a day."""
    epoch = lambda c: F.unix_seconds(F.to_utc_timestamp(c.cast("timestamp"), zone))
    return forecast.select(*KEYS, epoch(F.col("ts")).alias("from"), epoch(F.col("ts") + F.expr("interval 3 hours")).alias("to"), F.bround("value", 1).alias("value"))


def web_document(forecast: DataFrame, generated: str, zone: str = "Europe/Berlin") -> DataFrame:
    """(station, document): species by name, each with its windows; JSON."""
    data = web_measurements(forecast, zone).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("from", "to", "value"))).alias("data"))
    body = F.sort_array(F.collect_list(F.struct(F.col("species").alias("polle"), F.col("station").alias("location"), "data")))
    return data.groupBy("station").agg(body.alias("m")).select("station", F.to_json(F.struct(F.lit(generated).alias("generated"), F.col("station").alias("location"), F.col("m").alias("measurements"))).alias("document"))
