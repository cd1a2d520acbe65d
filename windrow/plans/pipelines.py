"""Compositions: collection, training and serving frames, backtest, recursive forecast, and the runs that chain them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windrow.functions.scalar import blend, calendar, confidence, days_since_onset, level, season_active, season_gate, typical_onset
from windrow.operators import align, evaluate, models, recursion
from windrow.operators import features as ft
from windrow.operators.evaluate import with_errors
from windrow.operators.forecast import KEYS, bridge_gaps, day_index, recent_state
from windrow.operators.weather import horizon, one_per_window
from windrow.params import FEATURES, INTRADAY, LAG_FEATURES, LAGS, PHENOLOGY, VEGETATION, WEATHER, with_params
from windrow.shared import small


def collect(values: DataFrame, archive: DataFrame, species: list[str], recent: DataFrame | None = None, aliases: DataFrame | None = None, vegetation: DataFrame | None = None, external: DataFrame | None = None, as_of=None) -> DataFrame:
    """The fact table's new rows from what has landed: alias stations merged, archive weather before recent, every species.

    ``values``: (station, species, ts, value), with a column chunk where they come from a backfill by chunks, of which
    the last that has a key wins; ``archive`` and ``recent``: weather windows; ``vegetation``: (station, date, ndvi, evi,
    ndvi_delta) by day; ``external``: (station, species, ts, cams_pollen); ``as_of``: windows after it are left out.
    """
    if "chunk" in values.columns:
        values = align.merge_chunks(values)
    values = align.merge_aliases(values, aliases) if aliases is not None else values.groupBy(*align.KEY).agg(F.max("value").alias("value"))
    weather = archive if recent is None else align.prefer(archive, recent, ["station", "ts"])
    return align.build_history(values, weather, vegetation, external, species, as_of)


def backfill(values: DataFrame, archive: DataFrame, species: list[str], recent: DataFrame | None = None, **more) -> DataFrame:
    """``collect`` without an external forecast; with archive weather only where ``recent`` is None."""
    return collect(values, archive, species, recent, **more, external=None)


def feature_frame(history: DataFrame, weather: DataFrame, params: DataFrame, onset: DataFrame | None = None, lags: bool = True, shard_days: int | None = None) -> DataFrame:
    """All features for all series in one plan: weather once per (station, window), thresholds after the species join, then lags.

    ``history``: (station, species, ts, value) and any of the vegetation and external columns; ``onset``: (species, mean);
    ``shard_days``: windows are made in shards of so many days, for series too long for one task.
    """
    ready = ft.weather_features(ft.complete(weather, WEATHER), shard_days)
    df = history.drop(*[c for c in ready.columns if c not in ("station", "ts")]).join(ready, ["station", "ts"])
    df = ft.threshold_features(with_params(df, params), shard_days).withColumns(calendar(F.col("ts")))
    if onset is None:
        df = df.withColumn("mean", F.lit(None).cast("double"))
    else:
        df = df.join(small(onset.select("species", "mean")), "species", "left")
    usual = typical_onset(F.col("mean"), F.col("typical_onset_doy"), F.col("season_start"))
    df = df.withColumn("days_since_typical_onset", days_since_onset(F.col("day_of_year").cast("double"), usual)).drop("mean")
    df = df.withColumn("season_active", season_active(F.col("month"), F.col("season_start"), F.col("season_end")).cast("double"))
    df = ft.complete(df, [*VEGETATION, *PHENOLOGY, *INTRADAY, "cams_pollen"])
    return ft.lag_features(df, shard_days) if lags else df


def training_frame(history: DataFrame, weather: DataFrame, params: DataFrame, onset: DataFrame | None = None, shard_days: int | None = None) -> DataFrame:
    """Rows after the warm-up of 56 windows, without nulls."""
    return ft.drop_warm_up(feature_frame(history, weather, params, onset, shard_days=shard_days)).fillna(0.0)


def serving_frame(weather: DataFrame, ahead: DataFrame, species: list[str], params: DataFrame, onset: DataFrame | None = None, vegetation: DataFrame | None = None, days: int = 5, external: DataFrame | None = None, past: DataFrame | None = None, shard_days: int | None = None) -> DataFrame:
    """Features without lags of the ``days`` from each station's first window in ``ahead``, for every species.

    Weather features see the stored windows and the forecast ones, of which the forecast wins: the same functions as for
    training on one table.  ``vegetation``: (station, date, ndvi, evi, ndvi_delta); ``external``: (station, species, ts,
    cams_pollen); ``past``: the fact table's rows before, on which the runs of warm windows of a species go on.
    """
    both = align.prefer(ahead, weather, ["station", "ts"])
    grid = horizon(ahead, days).select("station", "ts").distinct().withColumn("species", F.explode(F.array(*map(F.lit, species))))
    if vegetation is not None:
        grid = align.attach_daily(grid, vegetation, VEGETATION)
    if external is not None:
        grid = align.attach(grid, external, align.KEY, ["cams_pollen"])
    grid = grid.withColumn("_ahead", F.lit(True))
    if past is not None:
        grid = grid.unionByName(past.select("station", "species", "ts").join(grid.select("station", "ts").distinct(), ["station", "ts"], "left_anti").withColumn("_ahead", F.lit(False)), allowMissingColumns=True)
    return feature_frame(grid, both, params, onset, lags=False, shard_days=shard_days).where("_ahead").drop("_ahead")


def train(history: DataFrame, params: DataFrame, stage, onset: DataFrame | None = None, features: list[str] = FEATURES, shard_days: int | None = None, **how) -> models.Classes:
    """A model of each tuning class from the fact table.  ``stage`` writes a DataFrame to shared storage and reads it back."""
    frame = stage(training_frame(history, one_per_window(history, WEATHER), params, onset, shard_days))
    return models.fit_classes(frame, features, **how)


def run(table: str, staging: str, new: DataFrame, ahead: DataFrame, params: DataFrame, stage, model: models.Classes | None = None, onset: DataFrame | None = None, expert: DataFrame | None = None, days: int = 5, features: list[str] = FEATURES, vegetation: DataFrame | None = None, external: DataFrame | None = None, on_gap: str = "decay", gate_observed: bool = True, observed_requires_measurement: bool = True, **how) -> DataFrame:
    """Upsert ``new`` (from ``collect``, with ingest_ts) into the fact table at ``table``, and forecast the windows ``ahead``.

    Without a model one is trained on the table first.  Windows of ``ahead`` that the table already has are observed; the
    state is of the windows before them.  ``vegetation`` and ``external`` are what ``collect`` takes, for the days ahead.
    Windows that are missing between a series' last row and its first one ahead are bridged (``on_gap``: "decay", or
    "error", see operators.forecast.bridge_gaps).  ``observed_requires_measurement``: zeros that were put in for a species
    that a measured window lacks aren't observations; without it they are.
    """
    align.upsert_table(table, new, staging)
    stored = new.sparkSession.read.parquet(table).drop("month_start")
    model = train(stored, params, stage, onset, features, **how) if model is None else model
    species = [r.species for r in params.select("species").distinct().orderBy("species").collect()]  # a dimension
    first = ahead.groupBy("station").agg(F.min("ts").alias("first"))
    past = stored.join(first, "station").where(F.col("ts") < F.col("first"))
    serving = stage(serving_frame(one_per_window(stored, WEATHER), ahead, species, params, onset, vegetation, days, external, past, how.get("shard_days")))
    empty = F.array().cast("array<double>")
    begins = serving.groupBy(*KEYS).agg(F.min("ts").alias("first"))
    series = begins.select(*KEYS).join(bridge_gaps(recent_state(past.drop("first")), begins, on_gap), KEYS, "left")
    series = series.withColumn("logs", F.coalesce("logs", F.array_repeat(F.lit(0.0), 56))).withColumn("today", F.coalesce("today", empty))
    observed = (stored.where("is_measured") if observed_requires_measurement else stored).join(first, "station").where(F.col("ts") >= F.col("first")).select(*KEYS, "ts", F.col("value").alias("observed"))
    return recursive_forecast(model, serving, series, observed, expert, gate_observed)


def benchmark(history: DataFrame, params: DataFrame, stage, onset: DataFrame | None = None, expert: DataFrame | None = None, n_folds: int | None = None, features: list[str] = FEATURES, mode: str = "one_step", days: int = 5, **how) -> dict[str, DataFrame]:
    """Backtest over monthly folds and its reports: results, overall, by_species, by_fold, bias, very_high, in_season, both also overall, worst, expert; by_step where the backtest is recursive."""
    frame = stage(training_frame(history, one_per_window(history, WEATHER), params, onset))
    results = stage(backtest(frame, evaluate.fold_table(history, n_folds=n_folds), features, mode, history, days, **how))
    season = with_params(results, params).where(season_active(F.month("ts"), F.col("season_start"), F.col("season_end")))
    found = {
        "results": results, "overall": evaluate.metrics(results), "by_species": evaluate.metrics(results, ["species"]), "by_fold": evaluate.metrics(results, ["fold"]), "bias": evaluate.bias_report(results),
        "very_high": evaluate.metrics(results, ["species"], F.col("level_actual") == "very_high"), "in_season": evaluate.metrics(season, ["species"]), "worst": evaluate.worst(results),
        "very_high_overall": evaluate.metrics(results, where=F.col("level_actual") == "very_high"), "in_season_overall": evaluate.metrics(season),
    }
    if mode == "recursive":
        found["by_step"] = evaluate.metrics(results, ["step"])
    return found if expert is None else found | {"expert": evaluate.head_to_head(results, expert)}


RESULTS = "station string, species string, ts timestamp_ntz, fold int, actual double, predicted double, error double, abs_error double, level_actual string, level_predicted string"


def origins(rows: DataFrame, history: DataFrame, days: int) -> tuple[DataFrame, DataFrame]:
    """(rows with origin and step, states): the rolling origins of a month, each with the ``days`` that follow.

    ``rows`` of one month; an origin is every ``days``-th midnight from its first day on, and each row belongs to one.  The
    state of a series at an origin is that of operators.forecast.recent_state over its rows before, made by windows over
    ``history`` for the first row from each origin on.
    """
    first = F.to_date(F.trunc(F.to_date("ts"), "month"))
    origin = F.date_add(first, (F.floor(F.datediff(F.to_date("ts"), first) / days) * days).cast("int"))
    keys = [*KEYS, "origin"]
    rows = rows.withColumn("origin", origin)
    rows = rows.withColumn("step", F.row_number().over(Window.partitionBy(*keys).orderBy("ts")))
    w, day = Window.partitionBy(*KEYS).orderBy("ts"), Window.partitionBy(*KEYS, F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    past = history.select(*KEYS, "ts", "value").withColumn("_log", F.log1p("value")).withColumn("origin", origin)
    past = past.withColumn("_n", F.row_number().over(w)).withColumn("_last", F.max(F.when(F.col("value") > 0, F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    past = past.withColumns({"_logs": F.collect_list("_log").over(w.rowsBetween(-56, -1)), "today": F.collect_list("_log").over(day)})
    run = F.when(F.col("_n") > 1, F.col("_n") - 1 - F.coalesce("_last", F.lit(0)))
    starts = rows.where("step = 1").select(*keys, "ts")
    logs = F.concat(F.array_repeat(F.lit(0.0), F.lit(56) - F.size("_logs")), "_logs")
    states = past.drop("origin").join(starts, [*KEYS, "ts"]).select(*keys, logs.alias("logs"), run.cast("long").alias("run"), "today", F.to_date("ts").alias("day"))
    return rows, states


def _recursive(model: models.Classes, rows: DataFrame, history: DataFrame, days: int) -> DataFrame:
    """``rows`` of a month with predicted, each from the state at its origin and the predictions since."""
    rows, states = origins(rows, history, days)
    gate = season_gate(F.col("month"), F.col("season_start"), F.col("season_end"))
    rows = rows.withColumn("open", gate).withColumn("observed", F.lit(None).cast("double"))
    return recursion.forecast(model, rows, states, [*KEYS, "origin"]).where("has_model")


def backtest(frame: DataFrame, folds: DataFrame, features: list[str], mode: str = "one_step", history: DataFrame | None = None, days: int = 5, **tuning) -> DataFrame:
    """Per fold: fit the tuning classes before the month, predict it, gate, errors and levels.

    ``mode``: "one_step" predicts each window from the true values before it; "recursive" forecasts ``days`` from rolling
    origins in the month on, as serving does, from the values of ``history`` before an origin and its own since, and adds
    the columns origin and step (from 1).  ``folds`` (fold, month_start) is a few rows; each fold is a distributed fit.
    Rows of species without a model in a fold are left out, as are folds without any; without folds there are no rows.
    """
    if mode not in ("one_step", "recursive") or mode == "recursive" and history is None:
        raise ValueError(f"mode {mode!r} {'without a history' if mode == 'recursive' else 'is unknown'}")
    more = ["origin", "step"] if mode == "recursive" else []
    out = None
    for f in folds.orderBy("month_start").collect():
        month = F.lit(str(f.month_start)).cast("date")
        model = models.fit_classes(frame.where(F.to_date("ts") < month), features, **tuning)
        test = frame.where(F.to_date(F.trunc(F.to_date("ts"), "month")) == month)
        if model.models:
            got = _recursive(model, test, history, days) if more else models.predict(model, test).where("p is not null")
            got = got.select(*KEYS, "ts", "value", "predicted", "month", "season_start", "season_end", "low_max", "moderate_max", "high_max", *more).withColumn("fold", F.lit(f.fold))
            out = got if out is None else out.unionByName(got)
    if out is None:
        return frame.sparkSession.createDataFrame([], RESULTS + (", origin date, step int" if more else ""))
    gate = season_gate(F.col("month"), F.col("season_start"), F.col("season_end"))
    cut = lambda c: level(F.col(c), F.col("low_max"), F.col("moderate_max"), F.col("high_max"))
    out = out.withColumn("actual", F.col("value")).withColumn("predicted", F.when(gate, F.col("predicted")).otherwise(0.0))
    out = with_errors(out).withColumn("level_actual", cut("actual")).withColumn("level_predicted", cut("predicted"))
    return out.select(*KEYS, "ts", "fold", "actual", "predicted", "error", "abs_error", "level_actual", "level_predicted", *more)


def state_features(df: DataFrame) -> DataFrame:
    """Lag features from a state's columns (operators.forecast.recent_state): logs, run, today, day."""
    at = lambda k: F.element_at("logs", -k)
    tail = lambda n: F.slice("logs", -n, n)
    mean = lambda a, n: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    columns = {f"lag_{k}": at(k) for k in LAGS}
    columns |= {"rolling_8": mean(tail(8), 8), "rolling_56": mean(F.col("logs"), 56), "max_8": F.array_max(tail(8)), "max_56": F.array_max("logs"), "windows_since_active": F.coalesce(F.col("run").cast("double"), F.lit(999.0))}
    columns["morning_avg"] = F.when((F.col("day") == F.to_date("ts")) & (F.size("today") > 0), mean(F.col("today"), F.size("today"))).otherwise(0.0)
    return df.withColumns(columns)


def recursive_forecast(model: models.Staged | models.Classes, serving: DataFrame, state: DataFrame, observed: DataFrame | None = None, expert: DataFrame | None = None, gate_observed: bool = True) -> DataFrame:
    """(station, species, ts, level, value, confidence, is_observed) for every window of ``serving``, in one job.

    ``serving``: features of the future windows without lags, species parameters included.  ``state``: of
    operators.forecast.recent_state, from the rows before the first window.  In a step the order is observe or predict,
    blend, gate, append; the state gets the gated value before blending.  A species without a model goes on from its last
    value, less a fifth each step.  Series without a state are left out.  ``gate_observed``: out of season an observed
    value counts as 0 too.
    """
    rows = day_index(serving)
    rows = rows.join(observed.select(*KEYS, "ts", "observed"), [*KEYS, "ts"], "left") if observed is not None else rows.withColumn("observed", F.lit(None).cast("double"))
    gate = season_gate(F.col("month"), F.col("season_start"), F.col("season_end"))
    rows = rows.withColumn("open", gate if gate_observed else gate | F.col("observed").isNotNull())
    got = recursion.forecast(model, rows, state).withColumn("date", F.to_date("ts"))
    got = got.join(expert.select("species", "date", F.col("level").alias("expert")), ["species", "date"], "left") if expert is not None else got.withColumn("expert", F.lit(None).cast("double"))
    low, moderate, high = F.col("low_max"), F.col("moderate_max"), F.col("high_max")
    blended = F.coalesce("observed", blend(F.col("predicted"), F.col("expert"), low, moderate, high))
    final, seen = F.when(F.col("open"), blended).otherwise(0.0), F.col("observed").isNotNull()
    return got.select(*KEYS, "ts", level(final, low, moderate, high).alias("level"), final.alias("value"), confidence(F.col("day_index"), F.col("has_model"), seen).alias("confidence"), seen.alias("is_observed"))


__all__ = ["LAG_FEATURES", "backfill", "backtest", "benchmark", "collect", "feature_frame", "recursive_forecast", "run", "serving_frame", "state_features", "train", "training_frame"]
