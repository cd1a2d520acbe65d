"""Hand fixtures: edges of the scalar functions, streaks, seasons, upserts, readers, documents."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from windrow.functions import scalar as sc
from windrow.operators import align, features, forecast, vegetation, weather
from windrow.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def frame(spark, values, species="a"):
    return spark.createDataFrame([("s", species, at(3 * i), v) for i, v in enumerate(values)], "station string, species string, ts timestamp_ntz, value double")


@pytest.mark.parametrize("start,end,open_months", [(1, 4, {12, 1, 2, 3, 4, 5}), (11, 2, {10, 11, 12, 1, 2, 3}), (4, 4, {3, 4, 5})])
def test_season_gate_goes_over_the_year(spark, start, end, open_months):
    got = spark.range(1, 13).select(F.col("id").alias("m"), sc.season_gate(F.col("id"), F.lit(start), F.lit(end)).alias("o")).collect()
    assert {r.m for r in got if r.o} == open_months


@pytest.mark.parametrize("value,name", [(0.0, "none"), (-1.0, "none"), (5.0, "low"), (10.0, "low"), (10.0001, "moderate"), (50.0, "moderate"), (300.0, "high"), (300.1, "very_high")])
def test_levels_are_inclusive(spark, value, name):
    assert one(spark, sc.level(F.lit(value), F.lit(10.0), F.lit(50.0), F.lit(300.0))) == name


@pytest.mark.parametrize("expert,want", [(0.5, 20.0), (2.5, 30.0), (None, 30.0), (1.5, 30.0)])
def test_blend_rounds_half_to_even_and_goes_one_step(spark, expert, want):
    e = F.lit(expert).cast("double")
    assert one(spark, sc.blend(F.lit(30.0), e, F.lit(20.0), F.lit(50.0), F.lit(100.0))) == pytest.approx(want)


def test_danger_codes(spark):
    got = spark.createDataFrame([(c,) for c in ("0", "0-1", "3", "-1", "", None, "4")], "c string").select("c", sc.danger_code(F.col("c")).alias("x")).collect()
    assert {r.c: r.x for r in got} == {"0": 0.0, "0-1": 0.5, "3": 3.0, "-1": 0.0, "": 0.0, None: 0.0, "4": 0.0}


def test_epoch_window_over_dst(spark):
    utc = lambda *a: int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp())
    cases = {utc(2024, 3, 31, 1): dt.datetime(2024, 3, 31, 3), utc(2024, 3, 31, 0, 59): dt.datetime(2024, 3, 31, 0), utc(2024, 10, 27, 1, 30): dt.datetime(2024, 10, 27, 0), utc(2024, 10, 27, 2): dt.datetime(2024, 10, 27, 3)}
    got = spark.createDataFrame([(k,) for k in cases], "e long").select("e", sc.epoch_window(F.col("e")).alias("w")).collect()
    assert {r.e: r.w for r in got} == cases


def test_lags_never_see_the_current_row_or_later(spark):
    values = [float(i % 7) for i in range(70)]
    other = values[:-1] + [999.0]
    names = [c for c in features.lag_features(frame(spark, values)).columns if c not in ("station", "species", "ts", "value")]
    a, b = (features.lag_features(frame(spark, v)).orderBy("ts").select(names).collect() for v in (values, other))
    assert a == b
    assert features.drop_warm_up(features.lag_features(frame(spark, values))).count() == 14


def test_windows_since_active(spark):
    got = [r.windows_since_active for r in features.lag_features(frame(spark, [0.0, 0.0, 5.0, 0.0, 0.0, 1.0, 0.0])).orderBy("ts").collect()]
    assert got == [999, 1, 2, 0, 1, 2, 0]


def test_streak_is_strict_and_resets(spark):
    df = frame(spark, [5.0, 5.1, 6.0, None, 7.0])
    got = [r.s for r in features.streak(df, F.col("value") > 5, "s", ["station"]).orderBy("ts").collect()]
    assert got == [0, 1, 2, 0, 1]


def test_degree_days_reset_each_year(spark):
    rows = [("s", dt.date(2023, 12, 30), 10.0), ("s", dt.date(2023, 12, 31), 2.0), ("s", dt.date(2024, 1, 1), 7.0)]
    got = features.degree_days(spark.createDataFrame(rows, "station string, date date, temperature double")).orderBy("date").collect()
    assert [r.gdd for r in got] == [5.0, 5.0, 2.0]


def test_circular_mean_slope_and_nulls(spark):
    rows = [("s", at(0), 350.0, None, 1.0), ("s", at(1), 10.0, None, None), ("s", at(3), None, None, 4.0)]
    h = spark.createDataFrame(rows, "station string, time timestamp_ntz, wind_direction_10m double, precipitation double, temperature_2m double")
    a, b = weather.to_windows(h).orderBy("ts").collect()
    assert min(a.wind_direction, 360 - a.wind_direction) == pytest.approx(0, abs=1e-9)
    assert (a.precipitation_sum, a.temp_slope_3h, b.temp_variance_3h, b.wind_direction, b.soil_moisture_mean) == (0.0, 0.0, 0.0, 0.0, 0.0)


def test_interpolation_of_few_knots(spark):
    rows = [("s", dt.date(2024, 1, 1), 0.2, 0.1), ("s", dt.date(2024, 1, 5), 0.6, 0.3), ("s", dt.date(2024, 1, 9), -0.3, 0.5)]
    got = vegetation.interpolate(spark.createDataFrame(rows, "station string, date date, ndvi double, evi double")).orderBy("date").collect()
    assert [round(r.ndvi, 6) for r in got] == [0.2, 0.3, 0.4, 0.5, 0.6]
    assert got[0].ndvi_delta == 0.0 and round(got[1].ndvi_delta, 6) == 0.1


def test_upsert_table_is_idempotent(spark, tmp_path):
    rows = frame(spark, [1.0, 2.0]).withColumn("ingest_ts", F.lit("2024-01-01").cast("timestamp"))
    later = frame(spark, [7.0]).withColumn("ingest_ts", F.lit("2024-01-02").cast("timestamp"))
    path, staging = str(tmp_path / "t"), str(tmp_path / "staging")
    for batch in (rows, later, later):
        align.upsert_table(path, batch, staging)
    assert [r.value for r in spark.read.parquet(path).orderBy("ts").collect()] == [7.0, 2.0]


def test_densify_tells_measured_zeros(spark):
    got = align.densify(frame(spark, [0.0]), frame(spark, [0.0]), ["a", "b"]).orderBy("species").collect()
    assert [(r.species, r.value, r.is_measured) for r in got] == [("a", 0.0, True), ("b", 0.0, False)]


def test_fallback_gate_and_observations(spark):
    steps = [("s", "a", at(0), None, True), ("s", "a", at(3), 50.0, True), ("s", "a", at(6), None, True), ("s", "a", at(9), 9.0, False), ("s", "a", at(12), None, True)]
    steps = spark.createDataFrame(steps, "station string, species string, ts timestamp_ntz, observed double, open boolean")
    last = spark.createDataFrame([("s", "a", 10.0)], "station string, species string, value double")
    got = forecast.fallback(last, steps).orderBy("ts").collect()
    assert [r.value for r in got] == [8.0, 50.0, 40.0, 0.0, 0.0]


def test_documents(spark):
    f = frame(spark, [3.0, 0.1]).unionByName(frame(spark, [5.0, 0.2], "b")).withColumn("level", F.lit("low")).withColumn("confidence", F.lit(0.94445))
    doc = json.loads(forecast.window_document(f, "now").first().document)
    windows = doc["forecast"][0]["windows"]
    assert [s["name"] for s in windows[0]["species"]] == ["b", "a"] and windows[1]["species"] == [] and windows[0]["to"] == "03:00"
    web = json.loads(forecast.web_document(f, "now").first().document)
    assert [m["polle"] for m in web["measurements"]] == ["a", "b"] and web["measurements"][0]["data"][0]["from"] == int(dt.datetime(2023, 12, 31, 23, tzinfo=dt.timezone.utc).timestamp())


def test_readers(spark, tmp_path):
    def put(name, content):
        (tmp_path / name).write_text(content if isinstance(content, str) else json.dumps(content))
        return str(tmp_path / name)

    m = {"measurements": [{"polle": "Varia", "location": "L", "data": [{"from": 0, "to": 10800, "value": 1.0}]}, {"polle": "Betula", "location": "L", "data": [{"from": 0, "to": 10800, "value": 2.0}, {"from": 10800, "to": 21600, "value": 3.0}]}]}
    got = readers.measurements(spark, put("m.json", m)).orderBy("ts").collect()
    assert [(r.species, r.ts, r.value) for r in got] == [("Betula", dt.datetime(1970, 1, 1, 0), 2.0), ("Betula", dt.datetime(1970, 1, 1, 3), 3.0)]
    w = {"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1.0, None]}}
    assert [r.temperature_2m for r in readers.hourly_weather(spark, put("w.json", w), "s").collect()] == [1.0, None]
    v = {"subset": [{"calendar_date": "2024-01-01", "band": "250m_NDVI", "data": [5000]}, {"calendar_date": "2024-01-01", "band": "250m_EVI", "data": [2500]}, {"calendar_date": "2024-01-17", "band": "250m_EVI", "data": [1]}]}
    assert [(r.ndvi, r.evi) for r in readers.composites(spark, put("v.json", v), "s").collect()] == [(0.5, 0.25)]
    d = {"last_update": "bad", "content": [{"partregion_id": 121, "Pollen": {"Roggen": {"today": "0-1", "tomorrow": "-1"}, "Graeser": {"today": "2", "tomorrow": "1", "dayafter_to": "2-3"}, "Other": {"today": "3"}}}, {"partregion_id": 1, "Pollen": {}}]}
    got = readers.danger_levels(spark, put("d.json", d), 121, "2024-05-01").orderBy("date").collect()
    assert [(r.species, str(r.date), r.level) for r in got] == [("Poaceae", "2024-05-01", 2.0), ("Poaceae", "2024-05-02", 1.0), ("Poaceae", "2024-05-03", 2.5)]
    o = "Stations_id ; Referenzjahr ; Phase_id ; Jultag ;\n 1 ; 2020 ; 5 ; 100 ;\n 2 ; 2020 ; 5 ; 103 ;\n 1 ; 2021 ; 6 ; 90 ;\n 1 ; 2022 ; 5 ;  ;\n"
    assert [(r.year, r.onset_doy) for r in readers.onset(spark, put("o.txt", o), "Betula", [1, 2]).collect()] == [(2020, 102)]


def test_danger_payloads_of_one_file(spark, tmp_path):
    """Payloads a line are read as those of a file each; the query lands as few files as its table has parts, not one a row."""
    from windrow.queries import QUERIES
    from windrow.shared import scope

    entry = lambda day, code: {"last_update": f"{day} 11:00", "content": [{"partregion_id": 7, "Pollen": {"Birke": {"today": code, "tomorrow": "1", "dayafter_to": "0"}}}]}
    payloads = [json.dumps(entry(f"2024-04-0{k}", code)) for k, code in ((1, "3"), (2, "2"), (3, "-1"))]
    (tmp_path / "lines").write_text("\n".join(payloads))
    (tmp_path / "each").mkdir()
    for k, x in enumerate(payloads):
        (tmp_path / "each" / f"{k}.json").write_text(x)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    got = rows(readers.danger_levels(spark, str(tmp_path / "lines"), 7, "2024-01-01", by_line=True))
    assert got == rows(readers.danger_levels(spark, str(tmp_path / "each"), 7, "2024-01-01")) and len(got) == 5
    with scope(spark, "danger-test") as folder:
        assert QUERIES["a10_danger_levels"](spark, "/root/testdata/sf0.001").count() > 0
        files = [f for _, _, names in os.walk(folder.removeprefix("file:")) for f in names if f.startswith("part-")]
    assert 0 < len(files) <= 8


def test_rows_meet_stations_by_point(spark):
    """A query over the nearest points joins a row a point, not every row of a point with each of its stations."""
    from windrow.queries import QUERIES

    made = []
    whole = align.nearest_grid
    try:
        align.nearest_grid = lambda grid, *more: made.append((grid.count(), grid.select("lat", "lon").distinct().count())) or whole(grid, *more)
        QUERIES["a12_nearest_grid"](spark, "/root/testdata/sf0.01").collect()
    finally:
        align.nearest_grid = whole
    assert made == [(100, 100)]


def test_soil_of_either_payload(spark, tmp_path):
    """The first soil parameter that a payload has is taken, whatever its values; without any it is 0."""
    from windrow.operators.weather import to_windows
    from windrow.sources.readers import hourly_weather

    times = '"time": ["2024-01-01T00:00", "2024-01-01T01:00"]'
    payloads = {
        "archive": ('"soil_temperature_0_to_7cm": [7, 9], "soil_moisture_0_to_7cm": [0.2, 0.4]', 8.0, 0.3), "forecast": ('"soil_temperature_6cm": [1, 3], "soil_moisture_3_to_9cm": [0.1, 0.3]', 2.0, 0.2),
        "both": ('"soil_temperature_6cm": [1, null], "soil_temperature_0_to_7cm": [7, 9], "soil_moisture_3_to_9cm": [null, null], "soil_moisture_0_to_7cm": [0.2, 0.4]', 1.0, 0.0), "none": ('"cape": [1, 2]', 0.0, 0.0),
    }
    every = None
    for name, (text, temperature, moisture) in payloads.items():
        (tmp_path / f"{name}.json").write_text('{"hourly": {%s, %s}}' % (times, text))
        hourly = hourly_weather(spark, str(tmp_path / f"{name}.json"), name)
        every = hourly if every is None else every.unionByName(hourly)
    got = {r.station: (r.soil_temperature_mean, round(r.soil_moisture_mean, 9)) for r in to_windows(every).collect()}
    assert got == {name: (a, b) for name, (_, a, b) in payloads.items()}


@pytest.mark.parametrize("n", [0, 1, 2, 7, 5000])
def test_exact_medians(spark, n):
    import random
    import statistics

    from windrow.operators.evaluate import medians

    r = random.Random(n)
    rows = [(r.choice(["a", "b", None]), float(r.choice([3, 3, 3, r.randrange(100)]))) for _ in range(n)] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    groups = {g: [v for k, v in rows if k == g and v is not None] for g in ("a", "b", None)}
    assert {x.g: x.median for x in medians(df, "v", ["g"], accuracy=50).collect()} == {g: statistics.median(v) for g, v in groups.items() if v}
    whole = [v for _, v in rows if v is not None]
    assert [x.median for x in medians(df, "v", accuracy=50).collect()] == ([statistics.median(whole)] if whole else [])


def test_scratch_of_a_scope_is_deleted(spark):
    from windrow.shared import discard, exists, scope, written

    with scope(spark, "work"):
        inner = written(spark.range(3))
        assert inner.count() == 3
    outer = written(spark.range(2))
    assert not exists(spark, inner.written_to) and exists(spark, outer.written_to)
    discard(outer)
    assert not exists(spark, outer.written_to)
