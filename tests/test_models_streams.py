"""Staged model, backtest and recursion on a small series; streams against batch."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.operators import align, models
from windrow.operators.forecast import recent_state
from windrow.params import SPECIES_PARAMS, species_params
from windrow.plans import pipelines
from windrow.streaming import streams

FEATURES = ["lag_1", "lag_8", "rolling_8", "hour_of_day", "temperature_mean"]


@pytest.fixture(scope="module")
def made(spark):
    hours = [dt.datetime(2024, 3, 20) + dt.timedelta(hours=3 * i) for i in range(200)]
    rows = [("s", sp, ts, float(max(0, (i * 7 + k * 3) % 13 - 4)) * (20 if i % 11 == 0 else 1)) for k, sp in enumerate(("Betula", "Salix")) for i, ts in enumerate(hours)]
    values = spark.createDataFrame(rows, "station string, species string, ts timestamp_ntz, value double")
    weather = spark.createDataFrame([("s", ts, float(i % 20), float(i % 3), float(50 + i % 40), 5.0, 90.0, 600.0) for i, ts in enumerate(hours)], "station string, ts timestamp_ntz, temperature_mean double, precipitation_sum double, humidity_mean double, wind_speed_max double, wind_direction double, sunshine_duration double")
    frame = pipelines.training_frame(values, weather, species_params(spark)).persist()
    return values, weather, frame


def test_training_frame_is_complete(made):
    from windrow.params import FEATURES as EVERY

    frame = made[2]
    assert set(EVERY) <= set(frame.columns) and frame.count() == 2 * (200 - 56)
    assert frame.select([F.count_if(F.col(c).isNull()).alias(c) for c in EVERY]).first() == tuple([0] * len(EVERY))


def test_fit_predict_and_leaf_quantiles(spark, made, tmp_path):
    model = models.fit(made[2], FEATURES, iterations=3, trees=4, depth=3, alpha=0.8)
    got = models.predict(model, made[2], ["station", "species", "ts"])
    r = got.agg(F.count("*").alias("n"), F.min("predicted").alias("lo"), F.min("p").alias("p0"), F.max("p").alias("p1")).first()
    assert r.n == 288 and r.lo >= 0 and 0 <= r.p0 <= r.p1 <= 1
    model.save(str(tmp_path / "m"))
    again = models.predict(models.Staged.load(spark, str(tmp_path / "m")), made[2], ["station", "species", "ts"])
    key = ["station", "species", "ts"]
    assert again.select(*key, F.round("predicted", 9)).subtract(got.select(*key, F.round("predicted", 9))).count() == 0
    covered = got.agg((F.sum(F.when(F.col("value") <= F.col("regression") + 1e-9, 1 + F.sqrt("value"))) / F.sum(1 + F.sqrt("value"))).alias("c")).first().c
    assert covered > 0.5


def test_nothing_to_fit(spark, made):
    """Where no species has both classes, predictions are null and a forecast goes on from the last value."""
    values, weather, frame = made
    model = models.fit(frame.withColumn("value", F.col("value") + 30), FEATURES, iterations=2, trees=2, depth=2)
    got = models.predict(model, frame).select("station", "species", "ts", "value", "p", "regression", "predicted")
    assert got.count() == 288 and got.where("p is not null or regression is not null or predicted is not null").isEmpty()
    assert models.fit(frame.withColumn("species", F.lit(None).cast("string")), FEATURES).models == {}
    cut = F.lit("2024-04-13").cast("timestamp_ntz")
    serving = pipelines.feature_frame(values, weather, species_params(spark), lags=False).where((F.col("ts") >= cut) & (F.col("ts") < cut + F.expr("interval 12 hours")))
    ahead = pipelines.recursive_forecast(model, serving, recent_state(values.where(F.col("ts") < cut))).collect()
    assert len(ahead) == 8 and not any(r.is_observed for r in ahead)


def test_recursive_forecast_keeps_order_and_observations(spark, made, tmp_path):
    values, weather, frame = made
    model = models.fit(frame, FEATURES, iterations=2, trees=2, depth=2)
    cut = F.lit("2024-04-13").cast("timestamp_ntz")
    serving = pipelines.feature_frame(values, weather, species_params(spark), lags=False).where((F.col("ts") >= cut) & (F.col("ts") < cut + F.expr("interval 12 hours")))
    n = [0]

    def stage(df):
        n[0] += 1
        df.write.parquet(str(tmp_path / str(n[0])))
        return spark.read.parquet(str(tmp_path / str(n[0])))

    observed = values.where(F.col("ts") == cut).select("station", "species", "ts", F.col("value").alias("observed"))
    got = pipelines.recursive_forecast(model, serving, recent_state(values.where(F.col("ts") < cut)), observed).orderBy("ts", "species").collect()
    assert len(got) == 8 and [r.is_observed for r in got[:2]] == [True, True] and not any(r.is_observed for r in got[2:])
    assert [r.value for r in got[:2]] == [r.observed for r in observed.orderBy("species").collect()]


def test_series_without_a_model_or_a_window_go_on(spark, made, tmp_path):
    """Without a model each step is four fifths of the one before; a series that lacks a window keeps its state."""
    values, weather, _ = made
    cut, gap = (F.lit(x).cast("timestamp_ntz") for x in ("2024-04-12 06:00:00", "2024-04-12 09:00:00"))
    serving = pipelines.feature_frame(values, weather, species_params(spark), lags=False).where((F.col("ts") >= cut) & (F.col("ts") < cut + F.expr("interval 12 hours")))
    serving = serving.where(~((F.col("species") == "Salix") & (F.col("ts") == gap)))
    n = [0]

    def stage(df):
        n[0] += 1
        df.write.parquet(str(tmp_path / str(n[0])))
        return spark.read.parquet(str(tmp_path / str(n[0])))

    past = values.where(F.col("ts") < cut)
    last = {r.species: r.v for r in past.groupBy("species").agg(F.max_by("value", "ts").alias("v")).collect()}
    got = pipelines.recursive_forecast(models.Classes({}), serving, recent_state(past)).orderBy("species", "ts").collect()
    assert [r.value for r in got] == pytest.approx([last["Betula"] * 0.8**k for k in (1, 2, 3, 4)] + [last["Salix"] * 0.8**k for k in (1, 2, 3)])
    assert all(r.confidence == pytest.approx(0.45) for r in got)


def test_run_trains_forecasts_and_takes_observations(spark, made, tmp_path):
    values, weather, _ = made
    n = [0]

    def stage(df):
        n[0] += 1
        df.write.parquet(str(tmp_path / str(n[0])))
        return spark.read.parquet(str(tmp_path / str(n[0])))

    cut = F.lit("2024-04-13").cast("timestamp_ntz")
    from windrow.operators.features import complete
    from windrow.params import WEATHER

    air = complete(weather, WEATHER).select("station", "ts", *WEATHER)
    new = pipelines.collect(values.where(F.col("ts") < cut + F.expr("interval 3 hours")), air, ["Betula", "Salix"]).withColumn("ingest_ts", F.lit("2024-04-13").cast("timestamp"))
    ahead = air.where((F.col("ts") >= cut) & (F.col("ts") < cut + F.expr("interval 9 hours")))
    two = species_params(spark).where("species in ('Betula', 'Salix')")
    got = pipelines.run(str(tmp_path / "t"), str(tmp_path / "s"), new, ahead, two, stage, features=FEATURES, iterations=2, trees=2).orderBy("ts", "species").collect()
    seen = {r.species: r.value for r in values.where(F.col("ts") == cut).collect()}
    assert [r.is_observed for r in got] == [True, True, False, False, False, False] and [r.value for r in got[:2]] == [seen["Betula"], seen["Salix"]]
    model = pipelines.train(spark.read.parquet(str(tmp_path / "t")), two, stage, features=FEATURES, iterations=2, trees=2)
    assert list(model.models) == ["4-5-85"]
    model.save(str(tmp_path / "m"))
    assert list(models.Classes.load(spark, str(tmp_path / "m")).models) == ["4-5-85"]
    reports = pipelines.benchmark(spark.read.parquet(str(tmp_path / "t")), two, stage, features=FEATURES)
    assert reports["results"].count() == 0 and reports["overall"].first().n == 0  # no month has sixty days before it


def test_backtest_has_levels_and_gate(spark, made):
    folds = spark.createDataFrame([(0, dt.date(2024, 4, 1))], "fold int, month_start date")
    got = pipelines.backtest(made[2], folds, FEATURES, iterations=2, trees=2, depth=2)
    assert got.where("fold = 0").count() == got.count() > 0 and got.where("predicted < 0 or level_predicted is null").count() == 0


def test_recursive_backtest_sees_nothing_after_its_origins(spark, made):
    """Values from an origin on don't change what is forecast from it; those before it do."""
    values, weather, frame = made
    folds = spark.createDataFrame([(0, dt.date(2024, 4, 1))], "fold int, month_start date")
    how = dict(mode="recursive", days=4, iterations=3, trees=3, depth=3)

    def run(v):
        got = pipelines.backtest(frame, folds, FEATURES, history=v, **how).collect()
        return {(r.species, r.ts): (r.origin, r.step, r.predicted) for r in got}

    base = run(values)
    steps = {o: sorted(s for (sp, _), (p, s, _) in base.items() if p == o and sp == "Betula") for o in {v[0] for v in base.values()}}
    assert sorted(steps) == [dt.date(2024, 4, d) for d in (1, 5, 9, 13)][: len(steps)] and all(s == list(range(1, len(s) + 1)) for s in steps.values()) and len(steps) >= 2
    cut = dt.datetime(2024, 4, 5)
    later = run(values.withColumn("value", F.when(F.col("ts") >= F.lit(cut), F.col("value") + 77).otherwise(F.col("value"))))
    for k, (origin, step, p) in base.items():
        if origin <= cut.date():
            assert later[k] == (origin, step, p)
    assert any(later[k] != base[k] for k in base)
    for mode, history in (("recursive", None), ("else", values)):
        with pytest.raises(ValueError):
            pipelines.backtest(frame, folds, FEATURES, mode=mode, history=history)


def test_observed_values_out_of_season(spark, made):
    values, weather, frame = made
    model = models.Classes({})
    cut = F.lit("2024-04-12").cast("timestamp_ntz")
    closed = species_params(spark).withColumns({"season_start": F.lit(9), "season_end": F.lit(10)})
    serving = pipelines.feature_frame(values, weather, closed, lags=False).where((F.col("ts") >= cut) & (F.col("ts") < cut + F.expr("interval 6 hours")))
    observed = values.where(F.col("ts") == cut).select("station", "species", "ts", F.lit(33.0).alias("observed"))
    state = recent_state(values.where(F.col("ts") < cut))
    for gated, want in ((True, [0.0, 0.0]), (False, [33.0, 0.0])):
        got = pipelines.recursive_forecast(model, serving.where("species = 'Betula'"), state, observed, gate_observed=gated).orderBy("ts").collect()
        assert [r.value for r in got] == want


def test_species_table():
    assert len(SPECIES_PARAMS) == 11


def test_stream_equals_batch(spark, tmp_path):
    rows = [("s", "a", dt.datetime(2024, 1, 1, h), float(h)) for h in range(9)]
    schema = "station string, species string, ts timestamp_ntz, value double"
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(str(tmp_path / "in"))
    seen = {}

    def each(batch, _):
        for r in batch.collect():
            seen[r.ts] = (r.n, r.total, r.top)

    streams.run_available(streams.windowed(streams.read_landed(spark, str(tmp_path / "in"), schema)), each, str(tmp_path / "c"))
    assert seen == {dt.datetime(2024, 1, 1, h): (3, float(3 * h + 3), float(h + 2)) for h in (0, 3, 6)}


def test_stream_upsert_takes_late_rows(spark, tmp_path):
    schema = "station string, species string, ts timestamp_ntz, value double, ingest_ts timestamp"
    row = lambda v, day: spark.createDataFrame([("s", "a", dt.datetime(2024, 1, 1), v, dt.datetime(2024, 1, day))], schema)
    for v, day in ((1.0, 2), (2.0, 3)):
        row(v, day).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.read_landed(spark, str(tmp_path / "in"), schema)
        streams.run_available(stream, lambda b, _: align.upsert_table(str(tmp_path / "t"), b, str(tmp_path / "st")), str(tmp_path / "c"), mode="append")
    assert [r.value for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [2.0]


SCHEMA = "station string, species string, ts timestamp_ntz, value double"


def fed(spark, tmp_path, batches, **how):
    """What the lag state gives out for batches that land one after the other, each run going on from the checkpoint."""
    streams.use_state_store(spark)
    got = []
    for rows in batches:
        spark.createDataFrame([(*k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), float(v)) for k, h, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.lag_state(streams.read_landed(spark, str(tmp_path / "in"), SCHEMA), **how)
        streams.run_available(stream, lambda b, _: got.extend((r.station, (r.ts - dt.datetime(2024, 1, 1)).total_seconds() / 3600, round(r.value, 6), [round(x, 6) for x in np.expm1(r.logs)]) for r in b.collect()), str(tmp_path / "c"), "append")
    return got


def test_lag_state_goes_on_between_runs_and_takes_late_readings(spark, tmp_path):
    a, b = ("s", "a"), ("t", "a")
    got = fed(spark, tmp_path, [[(a, 0, 1), (b, 0, 7)], [(a, 6, 3), (a, 3, 2)], [(a, 4, 9), (a, 9, 4)], [(a, 12, 5)]], n=3)
    assert sorted(got) == [("s", 0, 1, []), ("s", 3, 2, [1]), ("s", 4, 9, [1, 2]), ("s", 6, 3, [1, 2]), ("s", 9, 4, [2, 9, 3]), ("s", 12, 5, [9, 3, 4]), ("t", 0, 7, [])]


def test_lag_state_drops_what_is_too_late_and_ends_silent_series(spark, tmp_path):
    a, b = ("s", "a"), ("t", "a")
    batches = [[(a, 0, 1), (b, 0, 7)], [(b, 24 * 5, 8)], [(b, 24 * 6, 9), (a, 1, 4)], [(b, 24 * 7, 9)], [(a, 24 * 8, 2)]]
    got = fed(spark, tmp_path, batches, late="1 day", silent=3)
    of = {(s, h): logs for s, h, _, logs in got}
    assert ("s", 1) not in of and of["s", 24 * 8] == []  # its state had ended
    assert of["t", 24 * 5][-1:] in ([7.0], []) and of["t", 24 * 7][-1] == 9


def test_first_reading_wins(spark, tmp_path):
    schema = "station string, species string, ts timestamp_ntz, value double"
    spark.createDataFrame([("s", "a", dt.datetime(2024, 1, 1), 1.0)] * 3, schema).write.parquet(str(tmp_path / "in"))
    rows = []
    streams.run_available(streams.first_reading(streams.read_landed(spark, str(tmp_path / "in"), schema)), lambda b, _: rows.extend(b.collect()), str(tmp_path / "c"), mode="append")
    assert len(rows) == 1
