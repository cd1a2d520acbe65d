"""The one-job recursion against a loop over MLlib's own predictions; gaps and states; sharded windows against whole ones."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.operators import features as ft
from windrow.operators import models, recursion, sharded
from windrow.operators.forecast import bridge_gaps, recent_state
from windrow.params import species_params
from windrow.plans import pipelines

FEATURES = ["lag_1", "lag_2", "lag_56", "rolling_8", "rolling_56", "max_8", "morning_avg", "windows_since_active", "hour_of_day", "temperature_mean"]
KEYS = ["station", "species"]


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(2)
    hours = [dt.datetime(2024, 3, 18) + dt.timedelta(hours=3 * i) for i in range(220)]
    rows = [(st, sp, ts, float(max(0, r.randrange(-40, 60))) * (9 if r.random() < 0.15 else 1)) for st in ("s", "t") for sp in ("Betula", "Poaceae", "Salix") for ts in hours]
    values = spark.createDataFrame(rows, "station string, species string, ts timestamp_ntz, value double").persist()
    weather = spark.createDataFrame([(st, ts, float(i % 20), float(i % 3), float(50 + i % 40), 5.0, 90.0, 600.0) for st in ("s", "t") for i, ts in enumerate(hours)], "station string, ts timestamp_ntz, temperature_mean double, precipitation_sum double, humidity_mean double, wind_speed_max double, wind_direction double, sunshine_duration double").persist()
    return values, weather, pipelines.training_frame(values, weather, species_params(spark)).persist()


def looped(spark, model, serving, state, observed):
    """Window by window: state features and predictions by Spark, everything else here."""
    of = {(s.station, s.species): [list(s.logs), s.run, list(s.today or []), s.day] for s in state.collect()}
    seen = {(o.station, o.species, o.ts): o.observed for o in observed.collect()}
    out = {}
    shape = "station string, species string, logs array<double>, run long, today array<double>, day date"
    for ts in sorted({x.ts for x in serving.select("ts").collect()}):
        now = spark.createDataFrame([(*k, *v) for k, v in of.items()], shape)
        for x in models.predict(model, pipelines.state_features(serving.where(F.col("ts") == F.lit(ts)).join(now, KEYS))).collect():
            k = (x.station, x.species)
            logs, run, today, day = of[k]
            guess = x.predicted if x.predicted is not None else 0.8 * math.expm1(logs[-1])
            gate = (x.month - x.season_start + 25) % 12 <= (x.season_end - x.season_start + 12) % 12 + 2
            kept = seen.get((*k, ts), guess) if gate else 0.0
            out[(*k, ts)] = guess
            log = math.log1p(kept)
            of[k] = [logs[1:] + [log], 0 if log > 0 else (run or 0) + 1, (today if day == ts.date() else []) + [log], ts.date()]
    return out


@pytest.mark.parametrize("classes", [False, True])
def test_one_job_equals_the_loop(spark, made, classes):
    values, weather, frame = made
    fit = models.fit_classes if classes else models.fit
    model = fit(frame, FEATURES, iterations=4, trees=5, depth=4)
    cut = F.lit("2024-04-13 09:00:00").cast("timestamp_ntz")
    serving = pipelines.feature_frame(values, weather, species_params(spark), lags=False).where((F.col("ts") >= cut) & (F.col("ts") < cut + F.expr("interval 30 hours"))).where("not (species = 'Salix' and hour(ts) = 15)").persist()
    observed = values.where((F.col("ts") == cut) & (F.col("station") == "t")).select(*KEYS, "ts", F.col("value").alias("observed"))
    state = recent_state(values.where(F.col("ts") < cut))
    want = looped(spark, model, serving, state, observed)
    rows = serving.join(observed, [*KEYS, "ts"], "left").withColumn("open", (F.col("month") - F.col("season_start") + 25) % 12 <= (F.col("season_end") - F.col("season_start") + 12) % 12 + 2)
    got = {(x.station, x.species, x.ts): (x.predicted, x.has_model) for x in recursion.forecast(model, rows, state).collect()}
    assert set(got) == set(want) and len(got) == 52
    assert [got[k][0] for k in want] == pytest.approx(list(want.values()), abs=1e-9)
    known = set(model.models) if classes else None
    assert all(m == (not classes or _class(spark, k[1]) in known) for k, (_, m) in got.items())
    assert len({round(v, 6) for v in want.values()}) > 20


def _class(spark, species):
    return spark.range(1).select(models.tuning_class(F.lit(species)).alias("c")).first().c


def test_flat_trees_are_mllibs(spark, made):
    model = models.fit(made[2], FEATURES, iterations=6, trees=7, depth=5)
    rows = models.predict(model, made[2].limit(400)).collect()
    x = np.array([[getattr(r, c) for c in FEATURES] for r in rows], float)
    assert recursion.FlatModel.of(model).predict(x).tolist() == pytest.approx([r.predicted for r in rows], abs=1e-9)


def test_the_number_of_jobs_does_not_follow_the_horizon(spark, made):
    values, weather, frame = made
    model = models.fit(frame, FEATURES, iterations=2, trees=2, depth=2)
    cut = F.lit("2024-04-08").cast("timestamp_ntz")
    serving = pipelines.feature_frame(values, weather, species_params(spark), lags=False).where(F.col("ts") >= cut)
    counts = []
    for hours in (6, 60):
        some = serving.where(F.col("ts") < cut + F.make_dt_interval(F.lit(0), F.lit(hours)))
        spark.sparkContext.setJobGroup(f"horizon{hours}", "")
        pipelines.recursive_forecast(model, some, recent_state(values.where(F.col("ts") < cut))).write.format("noop").mode("overwrite").save()
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"horizon{hours}")))
    spark.sparkContext.setJobGroup("", "")
    assert counts[0] == counts[1]


def test_state_has_the_run_and_the_day(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=3 * h)
    rows = [("a", "x", at(h), 5.0 if h == 3 else 0.0) for h in range(90)] + [("b", "x", at(h), 0.0) for h in range(10)] + [("c", "x", at(8), 2.0)]
    got = {r.station: r for r in recent_state(spark.createDataFrame(rows, "station string, species string, ts timestamp_ntz, value double")).collect()}
    assert (got["a"].run, got["b"].run, got["c"].run) == (86, 10, 0)
    assert [len(got[k].today) for k in "abc"] == [2, 2, 1] and got["c"].today == [math.log1p(2.0)] and len(got["c"].logs) == 56


def test_gaps_are_bridged_or_an_error(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=3 * h)
    state = recent_state(spark.createDataFrame([("a", "x", at(h), 10.0) for h in range(6)] + [("b", "x", at(h), float(h == 0)) for h in range(6)] + [("c", "x", at(5), 1.0)], "station string, species string, ts timestamp_ntz, value double"))
    begins = spark.createDataFrame([("a", "x", at(9)), ("b", "x", at(11)), ("c", "x", at(6))], "station string, species string, first timestamp_ntz")
    got = {r.station: r for r in bridge_gaps(state, begins).collect()}
    assert [math.expm1(v) for v in got["a"].logs[-4:]] == pytest.approx([10, 8, 6.4, 5.12]) and got["a"].run == 0
    assert [math.expm1(v) for v in got["a"].today] == pytest.approx([5.12]) and got["a"].day == dt.date(2024, 1, 2) and got["a"]["last"] == at(8)
    assert got["b"].run == 10 and len(got["b"].logs) == 56 and got["b"].today == [0.0] * 3
    assert got["c"].today == [math.log1p(1.0)] and got["c"].day == dt.date(2024, 1, 1)
    far = bridge_gaps(state.where("station = 'a'"), spark.createDataFrame([("a", "x", at(5000))], "station string, species string, first timestamp_ntz")).first()
    assert len(far.logs) == 56 and math.expm1(far.logs[-1]) == pytest.approx(10 * 0.8**4994)
    with pytest.raises(Exception, match="windows are missing before the first one of a x"):
        bridge_gaps(state, begins, "error").collect()
    assert bridge_gaps(state, begins.where("station = 'c'"), "error").count() == 1
    with pytest.raises(ValueError):
        bridge_gaps(state, begins, "else")


# ---- sharded windows --------------------------------------------------------------------------------------------------


def same(a, b, keys):
    names = sorted(a.columns)
    key = lambda r: tuple(str(r[k]) for k in keys)
    x, y = ({key(r): r for r in df.select(names).collect()} for df in (a, b))
    assert set(x) == set(y) and len(x) > 0 and sorted(b.columns) == names
    for k in x:
        for n in names:
            assert x[k][n] == (pytest.approx(y[k][n], abs=1e-9) if isinstance(y[k][n], float) else y[k][n]), (k, n)


@pytest.mark.parametrize("days", [1, 3, 40, 4000])
def test_shards_of_any_length_give_the_same_rows(spark, days):
    """Dense and sparse series, gaps longer than shards, null keys and values."""
    r = random.Random(days)
    start = dt.datetime(2023, 12, 20)
    rows = []
    for st, sp, chance in (("a", "x", 0.9), ("a", "y", 0.05), (None, "x", 0.5), ("b", None, 0.5), ("c", "x", 0.002)):
        rows += [(st, sp, start + dt.timedelta(hours=3 * h), r.choice([0.0, 0.0, 0.0, 3.0, None])) for h in range(900) if r.random() < chance and not 300 < h < 420]
    df = spark.createDataFrame(rows, "station string, species string, ts timestamp_ntz, value double")
    same(ft.lag_features(df, days), ft.lag_features(df), [*KEYS, "ts"])
    holds = F.col("value") == 0
    same(ft.streak(df, holds, "n", KEYS, days), ft.streak(df, holds, "n", KEYS), [*KEYS, "ts"])
    air = df.where("species = 'x'").select("station", "ts", F.coalesce("value", F.lit(1.0)).alias("temperature_mean"), F.col("value").alias("precipitation_sum"), F.lit(60.0).alias("humidity_mean"), F.lit(2.0).alias("wind_speed_max"), F.col("value").alias("sunshine_duration")).where("station is not null")
    same(ft.weather_features(air, days), ft.weather_features(air), ["station", "ts"])


def test_no_window_holds_a_whole_series(spark):
    """Every window over rows has the shard, or the day or year, among its partition keys."""
    df = spark.createDataFrame([], T.StructType([T.StructField("station", T.StringType()), T.StructField("species", T.StringType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("value", T.DoubleType())]))
    for plan in (ft.lag_features(df, 7), ft.streak(df, F.col("value") > 0, "n", KEYS, 7)):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        for line in text.splitlines():
            if "Window [" in line:
                keys = line[line.index("], [") :] if "], [" in line else line
                assert "_shard" in keys or "_n" in line, line


def test_halo_is_the_rows_before(spark):
    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    df = spark.createDataFrame([("a", "x", at(d), float(d)) for d in (0, 1, 2, 10, 11, 40)], "station string, species string, ts timestamp_ntz, value double")
    got = sharded.with_halo(df, KEYS, 5, 3).where("_halo").groupBy("_shard").agg(F.sort_array(F.collect_list("value")).alias("v")).orderBy("_shard").collect()
    assert [r.v for r in got][-1] == [2.0, 10.0, 11.0] and all(len(r.v) <= 3 for r in got)
