"""Splines against a dense solve, medians by narrowing against sorting, time frames on gaps."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.operators import evaluate, vegetation
from windrow.operators import features as ft


def dense(x, y, at):
    """A cubic for each piece by one linear system: values, first and second derivatives, third ones at the outer inner knots."""
    n = len(x) - 1
    a, b = np.zeros((4 * n, 4 * n)), np.zeros(4 * n)
    k = 0
    for i in range(n):
        h = x[i + 1] - x[i]
        a[k, 4 * i], b[k] = 1, y[i]
        a[k + 1, 4 * i : 4 * i + 4], b[k + 1] = [1, h, h**2, h**3], y[i + 1]
        k += 2
        if i + 1 < n:
            a[k, 4 * i : 4 * i + 4], a[k, 4 * i + 5] = [0, 1, 2 * h, 3 * h**2], -1
            a[k + 1, 4 * i : 4 * i + 4], a[k + 1, 4 * i + 6] = [0, 0, 2, 6 * h], -2
            k += 2
    a[k, 3], a[k, 7] = 1, -1
    a[k + 1, 4 * n - 5], a[k + 1, 4 * n - 1] = 1, -1
    c = np.linalg.solve(a, b).reshape(n, 4)
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 1)
    t = at - np.array(x)[i]
    return c[i, 0] + c[i, 1] * t + c[i, 2] * t**2 + c[i, 3] * t**3


def test_spline_is_not_a_knot(spark):
    r = random.Random(4)
    start = dt.date(2020, 1, 1)
    rows, want = [], {}
    for n in (1, 2, 3, 4, 5, 6, 23, 80):
        days = sorted(r.sample(range(n * 16), n))
        y = [round(r.uniform(-0.1, 0.9), 4) for _ in days]
        rows += [(f"s{n}", start + dt.timedelta(days=d), v) for d, v in zip(days, y)] + [(f"s{n}", start + dt.timedelta(days=n * 16 + 9), None)]
        at = np.arange(days[0], days[-1] + 1, dtype=float)
        got = dense(np.array(days, float) - days[0], y, at - days[0]) if n >= 4 else np.interp(at, days, y)
        want |= {(f"s{n}", start + dt.timedelta(days=int(d))): v for d, v in zip(at, got)}
    df = spark.createDataFrame(rows, "station string, date date, ndvi double")
    got = {(r.station, r.date): r.ndvi for r in vegetation.daily(df, "ndvi", "spline").collect()}
    assert set(got) == set(want)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6
    with pytest.raises(ValueError):
        vegetation.daily(df, "ndvi", "other")


def test_no_valid_composite_gives_zeros(spark):
    day = dt.date(2020, 1, 1)
    df = spark.createDataFrame([("a", day, -0.3, 0.1), ("a", day + dt.timedelta(days=16), 1.0, 0.2)], "station string, date date, ndvi double, evi double")
    days = vegetation.interpolate(df, "spline")
    assert days.count() == 0
    wanted = spark.createDataFrame([("a", day)], "station string, date date")
    assert [tuple(r)[2:] for r in vegetation.reindex(days, wanted, ["ndvi", "evi"]).collect()] == [(0.0, 0.0)]


@pytest.mark.parametrize("kind", ["spread", "ties", "few", "wide"])
def test_medians_by_narrowing(spark, kind):
    r = random.Random(kind)
    draw = {"spread": lambda: r.gauss(0, 1), "ties": lambda: float(r.randrange(5)) if r.random() < 0.8 else r.random() * 4, "few": lambda: float(r.randrange(3)), "wide": lambda: r.choice([-1, 1]) * 10 ** r.uniform(-200, 200)}[kind]
    rows = [(g, draw() if r.random() < 0.98 else None) for g, n in (("a", 5001), ("b", 3000), ("c", 1), ("d", 2), (None, 400)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {g: statistics.median([v for h, v in rows if h == g and v is not None] or [0]) for g in {g for g, v in rows if v is not None}}
    for most in (10_000, 4):
        got = {x.g: x["median"] for x in evaluate.medians(df, "v", ["g"], accuracy=200, most=most).collect()}
        assert got == want
    one = evaluate.medians(df, "v", accuracy=200, most=4).collect()
    assert [x["median"] for x in one] == [statistics.median([v for _, v in rows if v is not None])]


def test_what_a_narrowed_median_holds_does_not_follow_the_rows(spark):
    df = spark.range(400_000).select(F.xxhash64("id").cast("double").alias("_v"))
    bounds = df.groupBy().agg(evaluate._brackets(F.col("_v"), 100).alias("_b"), F.count("*").alias("_n")).select("_n", F.col("_b")[0].alias("_lo"), F.col("_b")[1].alias("_hi"))
    inside = lambda b: df.where(F.col("_v").between(b["_lo"], b["_hi"])).count()
    assert inside(bounds.first()) > 5000 and inside(evaluate._narrowed(df, bounds, [], 200, 1000).first()) <= 300
    assert evaluate.medians(df, "_v", accuracy=100, most=200).first()["median"] == df.select(F.median("_v")).first()[0]


def test_time_frames_do_not_shift_over_gaps(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    df = spark.createDataFrame([("a", "x", at(h), float(h + 1)) for h in (0, 3, 24, 27, 51, 300)], "station string, species string, ts timestamp_ntz, value double")
    for days in (None, 1, 30):
        got = ft.lag_features(df, days, "time").orderBy("ts").collect()
        log = lambda h: np.log1p(h + 1.0)
        assert [r.lag_8 for r in got] == [None, None, pytest.approx(log(0)), pytest.approx(log(3)), pytest.approx(log(27)), None]
        assert got[2].rolling_8 == pytest.approx((log(0) + log(3)) / 2) and got[5].rolling_8 is None and got[5].max_56 is None
        assert [r.windows_since_active for r in got] == [999, 0, 6, 0, 7, 82]
    assert [r.lag_8 for r in ft.lag_features(df).orderBy("ts").collect()] == [None] * 6  # by rows
    with pytest.raises(ValueError):
        ft.lag_features(df, frames="days")
